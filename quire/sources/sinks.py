"""Results: texts by job, fixtures, and PDF files with an invisible text layer, written by executors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.sources.documents import Rasterizer

# Advance widths of Helvetica in thousandths, for the characters from space to tilde
WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556,
    556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
OTHER_WIDTH = 556


def natural_width(text: Column, font_size: Column) -> Column:
    """The width of a text in points at a font size."""
    table = F.array(*map(F.lit, WIDTHS))
    each = F.transform(F.split(text, ""), lambda c: F.when((F.ascii(c) >= 32) & (F.ascii(c) <= 126), F.get(table, F.ascii(c) - 32)).otherwise(F.lit(OTHER_WIDTH)))
    return F.when(F.length(text) > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x) * font_size / 1000.0).otherwise(F.lit(0.0))


def job_texts(lines: DataFrame, job: str = "doc_id") -> DataFrame:
    """(job, text): a JSON object of each page's lines, pages and lines in order."""
    pages = lines.groupBy(job, "page_index").agg(F.expr("transform(array_sort(collect_list(struct(line_idx, text))), x -> x.text)").alias("lines"))
    entry = F.struct("page_index", F.struct(F.col("page_index").cast("string").alias("key"), F.col("lines").alias("value")).alias("e"))
    listed = pages.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    return listed.select(job, F.to_json(F.map_from_entries("entries")).alias("text"))


def put_texts(texts: DataFrame, path: str) -> None:
    texts.write.mode("append").parquet(path)


def text_of(spark: SparkSession, path: str, job: object, column: str = "doc_id") -> str | None:
    """A job's text, or None."""
    row = spark.read.parquet(path).where(F.col(column) == F.lit(job)).select("text").first()
    return row and row.text


def fixture(blocks: DataFrame, sizes: DataFrame, name: Column, keys: str = "doc_id") -> DataFrame:
    """(doc_id, json) of (doc_id, page_index, block_idx, box, text, label) and page sizes: y before x, whole pixels.

    Documents without blocks have no fixture.
    """
    b = F.col("box")
    px = [G.rounded(b["y0"] * F.col("height")), G.rounded(b["x0"] * F.col("width")), G.rounded(b["y1"] * F.col("height")), G.rounded(b["x1"] * F.col("width"))]
    order = F.struct("page_index", "block_idx")
    item = F.struct(order.alias("o"), F.col("text").alias("block_content"), F.array(*px).alias("bbox"), F.col("page_index"), F.coalesce("label", F.lit("text")).alias("block_label"))
    listed = blocks.join(sizes, [keys, "page_index"]).groupBy(keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    layout = F.transform(
        "items", lambda x, i: F.struct(x["block_content"].alias("block_content"), x["bbox"].alias("bbox"), i.alias("block_id"), x["page_index"].alias("page_index"), x["block_label"].alias("block_label"), F.lit(1.0).alias("score"))
    )
    dims = sizes.groupBy(keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "width", "height"))), lambda x: F.struct(x["width"].alias("width"), x["height"].alias("height"))).alias("pages"))
    short = F.replace(name, F.lit("output_"), F.lit(""))
    kind = F.when(F.endswith(F.lower(short), F.lit(".pdf")), "pdf").otherwise("image")
    info = F.struct("pages", F.size("pages").alias("num_pages"))
    inner = F.struct(short.alias("file_name"), kind.alias("file_type"), layout.alias("layout"), info.alias("data_info"))
    return listed.join(dims, keys).select(keys, F.to_json(F.struct(inner.alias("data"))).alias("json"))


def draw_commands(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, box_idx, x0, y0, x1, y1, colour): boxes in pixels, for whoever draws them over a page."""
    b = F.col("box")
    px = [(b[e] * F.lit(width if e[0] == "x" else height)).cast("int").alias(e) for e in G.EDGES]
    return boxes.select("doc_id", "box_idx", *px, F.when(G.refinable(b), "green").otherwise("red").alias("colour"))


# --- PDF -------------------------------------------------------------------------


def _string(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw) + b")"


def _image(image: bytes) -> tuple[bytes, bytes]:
    """(dictionary, data) of a page's picture."""
    if image.startswith(b"\xff\xd8"):
        return b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode", image
    from quire.sources.documents import decoded

    return b"/ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(decoded(image).tobytes())


def sandwich(pages: list[dict]) -> bytes:
    """A PDF file: each page a picture under invisible text. Pages have width and height in points, image with its
    pixel size, and spans of text, x, baseline_y (from the top), font_size and scale_x."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for p in pages:
        w, h = p["width"], p["height"]
        kind, data = _image(p["image"])
        n = len(objects) + 1
        drawn = [b"q %.4f 0 0 %.4f 0 0 cm /Im0 Do Q" % (w, h)]
        for s in p["spans"]:
            place = b"1 0 0 1 %.4f %.4f Tm" % (s["x"], h - s["baseline_y"])
            drawn.append(b"BT 3 Tr /F0 %.4f Tf %.4f Tz " % (s["font_size"], 100 * s["scale_x"]) + place + b" " + _string(s["text"]) + b" Tj ET")
        stream = b"\n".join(drawn)
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d " % (p["pixel_width"], p["pixel_height"]) + kind + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream")
        objects.append(b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Contents %d 0 R /Resources << /XObject << /Im0 %d 0 R >> /Font << /F0 3 0 R >> >> >>" % (w, h, n + 1, n))
        kids.append(n + 2)
    objects[1] = b"<< /Type /Pages /Count %d /Kids [" % len(kids) + b" ".join(b"%d 0 R" % k for k in kids) + b"] >>"
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for i, x in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % i + x + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


_shown = re.compile(rb"BT 3 Tr /F0 ([\d.]+) Tf ([\d.]+) Tz 1 0 0 1 (-?[\d.]+) (-?[\d.]+) Tm \(((?:[^\\()]|\\.)*)\) Tj ET")


def layer_of(content: bytes) -> list[dict]:
    """The text layer of a file that `sandwich` made: page, size, and each span's text and place. Other files need a PDF library."""
    out = []
    boxes = [tuple(map(float, m)) for m in re.findall(rb"/MediaBox \[0 0 ([\d.]+) ([\d.]+)\]", content)]
    streams = re.findall(rb"<< /Length \d+ >>\nstream\n(q .*?)\nendstream", content, re.S)
    for page, (stream, (w, h)) in enumerate(zip(streams, boxes)):
        for n, (size, scale, x, y, raw) in enumerate(_shown.findall(stream)):
            text = re.sub(rb"\\(.)", rb"\1", raw).decode("cp1252")
            out.append({"page_index": page, "span_idx": n, "page_width": w, "page_height": h, "text": text, "x": float(x), "baseline_y": h - float(y), "font_size": float(size), "scale_x": float(scale) / 100})
    return out


LAYER = "page_index int, span_idx int, page_width double, page_height double, text string, x double, baseline_y double, font_size double, scale_x double"


def layer_rows(docs: DataFrame) -> DataFrame:
    """The text layers of (doc_id, content), a row for each span."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LAYER.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), *[pa.float64()] * 4]
        for batch in it:
            for i, r in enumerate(batch.to_pylist()):
                rows = layer_of(r["content"])
                columns = [pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *columns], ["doc_id", *names])

    return docs.select("doc_id", "content").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {LAYER}")


Assembler = Callable[[list[dict]], bytes]


def assembled(docs: DataFrame, spans: DataFrame, rasterizer: Rasterizer, dpi: int = 200, assemble: Assembler = sandwich) -> DataFrame:
    """(doc_id, content): one file for each of `docs`, with all of its pages at their own size.

    Pages without spans stay, without text. A document's pictures are made where its file is put together, so that none
    of them travels.
    """
    span = F.struct("page_index", "box_idx", "path", "line", "text", "x", "baseline_y", "font_size", "scale_x")
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, r in enumerate(batch.to_pylist()):
                own: dict[int, list[dict]] = {}
                for s in r["spans"] or ():
                    own.setdefault(s["page_index"], []).append(s)
                sizes = rasterizer.sizes(r["content"], r["is_image"])
                pictures = rasterizer.backgrounds(r["content"], r["is_image"], dpi)
                pages = [
                    {"width": w, "height": h, "image": image, "pixel_width": pw, "pixel_height": ph, "spans": own.get(n, [])}
                    for n, ((w, h), (image, pw, ph)) in enumerate(zip(sizes, pictures))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([assemble(pages)], pa.binary())], ["doc_id", "content"])

    both = docs.select("doc_id", "is_image", "content").join(listed, "doc_id", "left")
    return both.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary")
