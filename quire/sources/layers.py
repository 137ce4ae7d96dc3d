"""What existing files hold: words and spans of text layers, page boxes, fixtures made of them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.sources import sinks


def _box(start: Column, end: Column) -> Column:
    """The place of a part of a span, in points from the page's top left."""
    y, size = F.col("baseline_y"), F.col("font_size")
    return G.box(F.col("x") + start, y - G.ASCENDER * size, F.col("x") + end, y - G.DESCENDER * size)


def words(spans: DataFrame) -> DataFrame:
    """(doc_id, page_index, span_idx, word_idx, box, word) of the spans of `layer_rows`: their words, each at its own place."""
    parts = F.split("text", " ")
    before = F.transform(parts, lambda p, i: F.struct(F.concat(F.array_join(F.slice(parts, F.lit(1), i), " "), F.when(i > 0, " ").otherwise("")).alias("before"), p.alias("word")))
    each = spans.select("*", F.posexplode(F.filter(before, lambda w: w["word"] != "")).alias("word_idx", "w"))
    width = lambda c: sinks.natural_width(c, F.col("font_size")) * F.col("scale_x")
    start = width(F.col("w.before"))
    return each.select("doc_id", "page_index", "span_idx", "word_idx", _box(start, start + width(F.col("w.word"))).alias("box"), F.col("w.word").alias("word"))


def fixtures_of(spans: DataFrame, sizes: DataFrame, name: Column) -> DataFrame:
    """(doc_id, json): fixtures of text layers, a block for each span that isn't blank; sizes as `page_boxes` gives them.

    Coordinates are whole points. Documents without blocks have no fixture.
    """
    whole = sizes.select("doc_id", "page_index", G.rounded(F.col("page_width")).alias("width"), G.rounded(F.col("page_height")).alias("height"))
    placed = spans.withColumn("text", X.strip(F.col("text"))).where("text <> ''").withColumn("pt", _box(F.lit(0.0), sinks.natural_width(F.col("text"), F.col("font_size")) * F.col("scale_x")))
    unit = G.box(F.col("pt.x0") / F.col("width"), F.col("pt.y0") / F.col("height"), F.col("pt.x1") / F.col("width"), F.col("pt.y1") / F.col("height"))
    blocks = placed.join(whole, ["doc_id", "page_index"]).select("doc_id", "page_index", F.col("span_idx").alias("block_idx"), unit.alias("box"), "text", F.lit(None).cast("string").alias("label"))
    return sinks.fixture(blocks, whole, name)


# --- page boxes of any PDF file ----------------------------------------------------

_object = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_numbers = rb"\s*\[\s*([-+\d.\s]+?)\s*\]"


def _objects(content: bytes) -> dict[int, bytes]:
    """The text of each object by its number, the last one of a number; those packed in object streams as well."""
    found = {int(n): body for n, body in _object.findall(content)}
    for body in list(found.values()):
        head, marked, data = body.partition(b"stream")
        if not marked or not re.search(rb"/Type\s*/ObjStm\b", head):
            continue
        data = data.lstrip(b"\r").removeprefix(b"\n")
        try:
            data = zlib.decompressobj().decompress(data) if b"/FlateDecode" in head else data
            count, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
            index = list(map(int, data[:first].split()))[: 2 * count]
        except (zlib.error, TypeError, ValueError):
            continue  # damaged or encrypted: its objects can't be read
        at = [first + i for i in index[1::2]] + [len(data)]
        for number, start, end in zip(index[::2], at, at[1:]):
            found.setdefault(number, data[start:end])
    return {n: body.partition(b"stream")[0] for n, body in found.items()}


def page_boxes_of(content: bytes) -> list[dict]:
    """Each page's rotation, media box, crop box and size as it is seen, in points, in the order of pages.

    What a page does not say it has from the nodes above it. Pages of encrypted object streams aren't found.
    """
    objects = _objects(content)
    out: list[dict] = []

    def read(body: bytes, above: dict) -> dict:
        own = dict(above)
        for key, name in ((b"MediaBox", "media_box"), (b"CropBox", "crop_box")):
            if m := re.search(b"/" + key + _numbers, body):
                own[name] = list(map(float, m[1].split()))
            elif (m := re.search(b"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)) and (m := re.search(_numbers, objects.get(int(m[1]), b""))):
                own[name] = list(map(float, m[1].split()))
        if m := re.search(rb"/Rotate\s+(-?\d+)", body):
            own["rotation"] = int(m[1]) % 360
        return own

    def put(own: dict) -> None:
        media = own.get("media_box", [0.0, 0.0, G.PAGE_WIDTH, G.PAGE_HEIGHT])
        crop = own.get("crop_box", media)
        size = [abs(crop[2] - crop[0]), abs(crop[3] - crop[1])]
        w, h = size[::-1] if own["rotation"] in (90, 270) else size
        out.append({"page_index": len(out), "rotation": own["rotation"], "media_box": media, "crop_box": crop, "page_width": w, "page_height": h})

    roots = [body for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body)]
    first = re.search(rb"/Pages\s+(\d+)", roots[-1]) if roots else None
    stack = [(int(first[1]), {"rotation": 0})] if first else []
    seen = set()
    while stack:
        number, above = stack.pop()
        if number in seen or number not in objects:
            continue
        seen.add(number)
        body = objects[number]
        own = read(body, above)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            stack += [(int(k), own) for k in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))]
        else:
            put(own)
    return out


def page_boxes(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, rotation, media_box, crop_box, page_width, page_height) of the pages of PDF files (doc_id, content)."""
    names = {"page_index": pa.int32(), "rotation": pa.int32(), "media_box": pa.list_(pa.float64()), "crop_box": pa.list_(pa.float64()), "page_width": pa.float64(), "page_height": pa.float64()}

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, content in enumerate(batch.column(1)):
                rows = page_boxes_of(content.as_py() or b"")
                columns = [pa.array([r[n] for r in rows], k) for n, k in names.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content").mapInArrow(each, f"doc_id {kind}, page_index int, rotation int, media_box array<double>, crop_box array<double>, page_width double, page_height double")
