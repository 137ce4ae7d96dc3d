"""Documents as rows, and their pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _named(files: DataFrame) -> DataFrame:
    """A document's id is its path: different files never share one."""
    return files.select(F.col("path").alias("doc_id"), "path", X.is_image(F.col("path")).alias("is_image"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, is_image, content) of the files below a path, read by executors."""
    return _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def landing(spark: SparkSession, folder: str, per_batch: int = 100, remove: bool = False) -> DataFrame:
    """The same as a stream of the files that arrive in a folder: the upload queue of a service.

    With `remove` files are deleted once they are worked on, which Spark does while a later batch ends.
    """
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_batch)
    stream = stream.option("cleanSource", "delete" if remove else "off")
    return _named(stream.load(folder))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, raw): each file's JSON as one text, for the parsers of answers and of ground truth."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"))


class Rasterizer(Protocol):
    """Turns files into page images. A file is opened once for all that is asked of it."""

    def sizes(self, content: bytes, is_image: bool) -> list[tuple[float, float]]:
        """(width, height) of each page in points."""

    def render(self, content: bytes, is_image: bool, pages: list[int], dpi: int, most: int) -> Iterator[tuple[bytes, int, int]]:
        """(image, width, height) of each of `pages`, for models: the longest edge has `most` pixels at most."""

    def backgrounds(self, content: bytes, is_image: bool, dpi: int) -> Iterator[tuple[bytes, int, int]]:
        """(image, width, height) of all pages, for output: pages at `dpi`, images as they are."""


class PlainPages:
    """The rasterizer of this engine's own test format: pages of PGM images, one after the other in a file, a point a pixel."""

    @staticmethod
    def _images(content: bytes) -> list[np.ndarray]:
        return [decoded(b"P5\n" + x) for x in content.split(b"P5\n")[1:]]

    def sizes(self, content: bytes, is_image: bool) -> list[tuple[float, float]]:
        return [(float(x.shape[1]), float(x.shape[0])) for x in self._images(content)]

    def render(self, content: bytes, is_image: bool, pages: list[int], dpi: int, most: int) -> Iterator[tuple[bytes, int, int]]:
        every = self._images(content) if pages else []
        for page in pages:
            image = shrunk(every[page], most)
            yield png(image), image.shape[1], image.shape[0]

    def backgrounds(self, content: bytes, is_image: bool, dpi: int) -> Iterator[tuple[bytes, int, int]]:
        for image in self._images(content):
            image = image if is_image else resized(image, *(round(x * dpi / 72) for x in image.shape[::-1]))
            yield png(image), image.shape[1], image.shape[0]


class RenderedPages:
    """The rasterizer of PDF and image files, where PyMuPDF and Pillow are installed; nothing here needs them."""

    #: Qualities of pictures for models, by kind of file, and of those for output.
    QUALITY = {False: 50, True: 80}
    OUTPUT_QUALITY = {False: 80, True: 85}

    @staticmethod
    def _frames(content: bytes, is_image: bool, pages: list[int] | None, dpi: int) -> Iterator:
        import io

        from PIL import Image, ImageSequence

        if is_image:
            with Image.open(io.BytesIO(content)) as image:
                for i, frame in enumerate(ImageSequence.Iterator(image)):
                    if pages is None or i in pages:
                        yield frame.convert("RGB").copy()
            return
        import fitz

        with fitz.open(stream=content) as doc:
            for i in range(len(doc)) if pages is None else pages:
                yield Image.open(io.BytesIO(doc[i].get_pixmap(dpi=dpi).tobytes("png"))).convert("RGB")

    def sizes(self, content: bytes, is_image: bool) -> list[tuple[float, float]]:
        if is_image:
            return [tuple(map(float, frame.size)) for frame in self._frames(content, True, None, 72)]
        import fitz

        with fitz.open(stream=content) as doc:
            return [(page.rect.width, page.rect.height) for page in doc]

    @staticmethod
    def _jpeg(picture, quality: int) -> tuple[bytes, int, int]:
        import io

        out = io.BytesIO()
        picture.save(out, "JPEG", quality=quality)
        return out.getvalue(), *picture.size

    def render(self, content: bytes, is_image: bool, pages: list[int], dpi: int, most: int) -> Iterator[tuple[bytes, int, int]]:
        for picture in self._frames(content, is_image, pages, dpi):
            picture.thumbnail((most, most))
            yield self._jpeg(picture, self.QUALITY[is_image])

    def backgrounds(self, content: bytes, is_image: bool, dpi: int) -> Iterator[tuple[bytes, int, int]]:
        for picture in self._frames(content, is_image, None, dpi):
            yield self._jpeg(picture, self.OUTPUT_QUALITY[is_image])


def decoded(image: bytes) -> np.ndarray:
    """Gray values of a PGM image or of one that `png` made; of any other kind where Pillow is installed."""
    if image.startswith(b"P5"):
        fields, at = [], 2
        while len(fields) < 3:
            while image[at : at + 1].isspace():
                at += 1
            end = at
            while not image[end : end + 1].isspace():
                end += 1
            fields.append(int(image[at:end]))
            at = end
        width, height, _ = fields
        return np.frombuffer(image, np.uint8, width * height, at + 1).reshape(height, width)
    if image.startswith(PNG) and image[24:26] == b"\x08\x00" and image[37:41] == b"IDAT" and image[-8:-4] == b"IEND":
        width, height, size = *struct.unpack(">II", image[16:24]), struct.unpack(">I", image[33:37])[0]
        if len(image) == 41 + size + 4 + 12:
            rows = np.frombuffer(zlib.decompress(image[41 : 41 + size]), np.uint8).reshape(height, width + 1)
            if not rows[:, 0].any():
                return rows[:, 1:]
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(image)).convert("L"))


def encoded(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d 255\n" % (gray.shape[1], gray.shape[0]) + np.ascontiguousarray(gray, np.uint8).tobytes()


PNG = b"\x89PNG\r\n\x1a\n"


def png(gray: np.ndarray) -> bytes:
    """A gray image as a PNG file, which models and PDF readers know."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = gray.shape
    rows = np.zeros((height, width + 1), np.uint8)  # each begins with the number of its filter, none
    rows[:, 1:] = gray
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def media_type(image: bytes) -> str:
    return "image/png" if image.startswith(PNG) else "image/jpeg" if image.startswith(b"\xff\xd8") else "image/x-portable-graymap"


def resized(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.arange(height) * gray.shape[0] // height
    return gray[rows][:, np.arange(width) * gray.shape[1] // width]


def shrunk(gray: np.ndarray, most: int) -> np.ndarray:
    longest = max(gray.shape)
    if longest <= most:
        return gray
    return resized(gray, *(max(1, round(x * most / longest)) for x in gray.shape[::-1]))


def page_sizes(docs: DataFrame, rasterizer: Rasterizer) -> DataFrame:
    """(doc_id, page_index, page_width, page_height) of all pages in points; nothing is rendered."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                sizes = rasterizer.sizes(batch.column(2)[i].as_py(), batch.column(1)[i].as_py())
                columns = [pa.array(range(len(sizes)), pa.int32()), *(pa.array([s[k] for s in sizes], pa.float64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(sizes), pa.int64())), *columns], ["doc_id", "page_index", "page_width", "page_height"])

    return docs.select("doc_id", "is_image", "content").mapInArrow(each, f"doc_id {kind}, page_index int, page_width double, page_height double")


def page_rows(docs: DataFrame, rasterizer: Rasterizer, pages: str | None = None, dpi: int = 150, most: int = 1024) -> DataFrame:
    """One row for each selected page: doc_id, page_index, n_pages, image, width and height in pixels, page_width and page_height in points.

    Pages are counted first and selected by the list `pages` (all if empty); only selected ones are rendered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = "array<struct<w:double,h:double>>"

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [[{"w": w, "h": h} for w, h in rasterizer.sizes(c.as_py(), k.as_py())] for c, k in zip(batch.column(2), batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("w", pa.float64()), ("h", pa.float64())])))], ["doc_id", "is_image", "content", "sizes"])

    def render(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "page_index", "n_pages", "image", "width", "height", "page_width", "page_height"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        for batch in it:
            for i, r in enumerate(batch.to_pylist()):
                n, wanted = len(r["sizes"]), r["wanted"]
                for page, (image, width, height) in zip(wanted, rasterizer.render(r["content"], r["is_image"], wanted, dpi, most)):
                    row = [page, n, image, width, height, r["sizes"][page]["w"], r["sizes"][page]["h"]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], k) for x, k in zip(row, kinds))], names)

    counted = docs.select("doc_id", "is_image", "content").mapInArrow(measure, f"doc_id {kind}, is_image boolean, content binary, sizes {sizes}")
    n = F.size("sizes")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    wanted = X.page_numbers(F.lit(pages), n) if pages else every
    page = f"doc_id {kind}, page_index int, n_pages int, image binary, width int, height int, page_width double, page_height double"
    return counted.withColumn("wanted", wanted).mapInArrow(render, page)
