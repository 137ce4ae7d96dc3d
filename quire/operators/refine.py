"""Second reading of blank boxes, and removal of what it reads twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

# Fixed values
RADIUS = 4
DENSE = 60
MODES = ("auto", "always", "never")


def dense_pages(boxes: DataFrame, mode: str = "auto", threshold: int = DENSE, group: str = "doc_id") -> DataFrame:
    """(group, n_boxes, dense): whether a page is read box by box."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    counts = boxes.groupBy(group).agg(F.count(F.lit(1)).alias("n_boxes"))
    dense = {"auto": F.col("n_boxes") > threshold, "always": F.lit(True), "never": F.lit(False)}[mode]
    return counts.withColumn("dense", dense)


def uncertain(boxes: DataFrame) -> DataFrame:
    """Blank boxes that are large enough for a word."""
    return boxes.where((X.strip(F.col("text")) == "") & G.refinable(F.col("box")))


def merged(boxes: DataFrame, read: DataFrame, keys: tuple[str, ...] = ("doc_id", "box_idx")) -> DataFrame:
    """`boxes` with the texts of `read` where there are any, blank ones too, and whether that was so."""
    again = read.select(*keys, X.strip(F.col("text")).alias("again"), F.lit(True).alias("found"))
    both = boxes.join(again, list(keys), "left").withColumn("refined", F.coalesce("found", F.lit(False)))
    return both.withColumn("text", F.when(F.col("refined"), F.col("again")).otherwise(F.col("text"))).drop("again", "found")


def without_duplicates(boxes: DataFrame, radius: int = RADIUS, group: str = "doc_id") -> DataFrame:
    """`boxes` (text, refined) with refined texts blank that stand in a text near them that was not refined."""
    form = X.dedup_form(F.col("text"))
    near = Window.partitionBy(group).orderBy("box_idx").rangeBetween(-radius, radius)
    first = F.when(~F.col("refined") & (F.col("text") != ""), form)
    held = boxes.withColumn("__form", form).withColumn("__near", F.collect_list(first).over(near))
    twice = F.col("refined") & (F.col("__form") != "") & F.exists("__near", lambda x: F.contains(x, F.col("__form")))
    return held.withColumn("text", F.when(twice, F.lit("")).otherwise(F.col("text"))).drop("__form", "__near")
