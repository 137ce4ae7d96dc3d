"""Jobs over documents: pages, boxes, texts and output files, as DataFrames from end to end."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import alignment, layer, ordering, responses
from quire.operators import refine as refining
from quire.sources import models, sinks
from quire.sources.documents import PlainPages, Rasterizer, page_rows, page_sizes

KEYS = ["doc_id", "page_index"]


@dataclass
class Settings:
    """What a job does; the command line has the same."""

    dpi: int = 200
    pages: str = ""
    concurrency: int = 1
    refine: bool = True
    max_image_dim: int = 1024
    dense_threshold: int = refining.DENSE
    dense_mode: str = "auto"

    @classmethod
    def of_service(cls) -> Settings:
        """What a service runs with: concurrency from the environment, three calls at once unless it says otherwise."""
        return cls(concurrency=int(os.environ.get("OCR_CONCURRENCY", 3)))

    def __post_init__(self) -> None:
        if self.dense_mode not in refining.MODES:
            raise ValueError(f"dense_mode must be one of {refining.MODES}, not {self.dense_mode!r}")


@dataclass
class Result:
    """boxes (doc_id, page_index, box_idx, box, text), lines (doc_id, page_index, line_idx, text), and progress."""

    boxes: DataFrame
    lines: DataFrame
    pages: DataFrame
    progress: list[tuple[str, int, int, str]] = field(default_factory=list)


def _kept(df: DataFrame, keep) -> DataFrame:
    return keep(df) if keep else df


def page_key(df: DataFrame) -> DataFrame:
    """`df` with `page`, document and page as one value, which the page operators take for their group."""
    return df.withColumn("page", F.struct(*KEYS))


def aligned(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, box_idx, box, text): lines bound to the boxes of their page, by the page operators."""
    paged, said = page_key(boxes), page_key(lines)
    own = paged.select(F.col("page").alias("doc_id"), "box_idx", "box")
    told = said.select(F.col("page").alias("doc_id"), "line_idx", "text")
    ranked = ordering.row_major(own).join(ordering.column_major(own).select("doc_id", "box_idx", "column_rank"), ["doc_id", "box_idx"])
    listed = lambda o, v: F.expr(f"transform(array_sort(collect_list(struct({o} as o, {v} as v))), x -> x.v)")
    sides = ranked.withColumn("area", G.capacity(F.col("box"))).groupBy("doc_id").agg(listed("box_idx", "area").alias("areas"), listed("row_rank", "box_idx").alias("by_row"), listed("column_rank", "box_idx").alias("by_column"))
    lengths = told.groupBy("doc_id").agg(listed("line_idx", "length(text)").alias("lengths"))
    both = sides.join(lengths, "doc_id", "full")
    ints, doubles = F.array().cast("array<int>"), F.array().cast("array<double>")
    both = both.select("doc_id", F.coalesce("lengths", ints).alias("lengths"), F.coalesce("areas", doubles).alias("areas"), F.coalesce("by_row", ints).alias("by_row"), F.coalesce("by_column", ints).alias("by_column"))
    found = alignment.aligned_text(told, alignment.aligned_pages(both))
    whole = G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    placed = found.join(own, ["doc_id", "box_idx"], "left").select(F.col("doc_id").alias("page"), F.greatest("box_idx", F.lit(0)).alias("box_idx"), F.coalesce("box", whole).alias("box"), "text")
    return placed.select("page.*", "box_idx", "box", "text")


def hybrid(
    docs: DataFrame, detector: models.Detector, page_reader: models.Reader, crop_reader: models.Reader, settings: Settings | None = None, rasterizer: Rasterizer | None = None, keep=None
) -> Result:
    """Boxes by a detector, texts by a reader, bound by alignment; dense pages box by box, blank boxes read again.

    `keep` writes an intermediate DataFrame and reads it back: model answers should be paid for once. A failing call
    ends the job.
    """
    s = settings or Settings()
    pages = _kept(page_rows(docs, rasterizer or PlainPages(), s.pages, s.dpi, s.max_image_dim), keep)
    boxes = _kept(models.detected(pages, detector), keep)
    every = page_key(pages.select(*KEYS))
    dense = refining.dense_pages(page_key(boxes), s.dense_mode, s.dense_threshold, "page").where("dense").select("page")
    dense = every.join(dense, "page", "left_semi").select(*KEYS)
    sparse = pages.join(dense, KEYS, "left_anti")
    # full pages
    raw = _kept(models.answers(sparse, page_reader, KEYS, s.concurrency), keep)
    lines = raw.select(*KEYS, F.posexplode(X.lines(X.without_front_matter(F.col("raw")))).alias("line_idx", "text"))
    lines = responses.clipped(lines, KEYS, "line_idx").withColumn("line_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("line_idx")) - 1)
    bound = aligned(boxes.join(dense, KEYS, "left_anti"), lines)

    def read(of: DataFrame) -> DataFrame:
        cut = models.crops(pages, of)
        said = models.answers(cut, crop_reader, [*KEYS, "box_idx"], s.concurrency)
        return _kept(said.select(*KEYS, "box_idx", X.crop_text(F.col("raw")).alias("text")), keep)

    # dense pages
    theirs = boxes.join(dense, KEYS, "left_semi")
    fits = theirs.where(G.refinable(F.col("box")))
    boxed = theirs.join(read(fits), [*KEYS, "box_idx"], "left").select(*KEYS, "box_idx", "box", F.coalesce("text", F.lit("")).alias("text"))
    if s.refine:
        again = refining.merged(bound, read(refining.uncertain(bound)), (*KEYS, "box_idx"))
        bound = refining.without_duplicates(page_key(again), group="page").select(*KEYS, "box_idx", "box", "text")
    per_box = boxed.where("text <> ''").withColumn("line_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("box_idx")) - 1)
    return Result(bound.unionByName(boxed), lines.unionByName(per_box.select(*KEYS, "line_idx", "text")), pages, [(x, 1, 1, x) for x in ("convert", "detect", "ocr", *(["refine"] if s.refine else []), "embed")])


def grounded(docs: DataFrame, reader: models.Reader, settings: Settings | None = None, rasterizer: Rasterizer | None = None, keep=None) -> Result:
    """Texts with boxes from one reader. All pages are read; a page that fails has no blocks, and its error is kept out."""
    s = settings or Settings()
    pages = _kept(page_rows(docs, rasterizer or PlainPages(), "", 150, s.max_image_dim), keep)
    raw = _kept(models.answers(pages, reader, KEYS, s.concurrency, keep_errors=True), keep)
    sized = raw.where("error is null").join(pages.select(*KEYS, F.col("width").alias("img_w"), F.col("height").alias("img_h")), KEYS)
    blocks = responses.freeform_blocks(sized, KEYS).withColumnRenamed("block_idx", "box_idx")
    lines = blocks.select(*KEYS, F.col("box_idx").alias("line_idx"), "text")
    return Result(blocks.select(*KEYS, "box_idx", "box", "text"), lines, pages, [(x, 1, 1, x) for x in ("ocr", "embed")])


def hosted(docs: DataFrame, reader: models.Reader, settings: Settings | None = None, rasterizer: Rasterizer | None = None, keep=None) -> Result:
    """Texts with boxes from a service that takes whole files, such as TaskReader asks. A failing file ends the job.

    Nothing is rendered for it; blocks of pages that a file doesn't have are left out.
    """
    s = settings or Settings()
    pages = _kept(page_sizes(docs, rasterizer or PlainPages()), keep)
    raw = _kept(models.answers(docs.select("doc_id", F.col("content").alias("image")), reader, ["doc_id"], s.concurrency), keep)
    blocks = responses.hosted_blocks(raw, ["doc_id"]).withColumnRenamed("block_idx", "box_idx").join(pages.select(*KEYS), KEYS, "left_semi")
    lines = blocks.select(*KEYS, F.col("box_idx").alias("line_idx"), "text")
    return Result(blocks.select(*KEYS, "box_idx", "box", "text"), lines, pages, [(x, 1, 1, x) for x in ("ocr", "embed")])


def output_files(result: Result, docs: DataFrame, rasterizer: Rasterizer | None = None, dpi: int = 200, assemble: sinks.Assembler = sinks.sandwich) -> DataFrame:
    """(doc_id, content) of each document's searchable file: all pages of `docs`, read or not, at their own size."""
    sized = result.boxes.join(result.pages.select(*KEYS, "page_width", "page_height"), KEYS)
    width, height = F.col("page_width"), F.col("page_height")
    cut = layer.tall_slices(layer.line_slices(sized.where(X.strip(F.col("text")) != "")).drop("slice_idx"), width, height)
    return sinks.assembled(docs, sinks_scaled(layer.drawn(cut, width, height)), rasterizer or PlainPages(), dpi, assemble)


def sinks_scaled(spans: DataFrame) -> DataFrame:
    return layer.scaled_to(spans, sinks.natural_width(F.col("text"), F.col("font_size")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Searchable files from scanned documents.")
    p.add_argument("input")
    p.add_argument("output", nargs="?", default="")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--dpi", type=int, default=200)
    p.add_argument("--pages", default="")
    p.add_argument("--concurrency", type=int, default=1)
    p.add_argument("--no-refine", dest="refine", action="store_false")
    p.add_argument("--max-image-dim", type=int, default=1024)
    p.add_argument("--dense-threshold", type=int, default=refining.DENSE)
    p.add_argument("--dense-mode", choices=refining.MODES, default="auto")
    p.add_argument("--grounded", action="store_true")
    p.add_argument("--api-base")
    p.add_argument("--model")
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    return Settings(args.dpi, args.pages, args.concurrency, args.refine, args.max_image_dim, args.dense_threshold, args.dense_mode)


def session(name: str = "quire") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
