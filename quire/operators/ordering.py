"""Reading orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
GAP = 0.2
LEAST = 4
#: Centres lie in 0..1 and each split takes a gap of GAP or more.
SPLITS = 5


def row_major(boxes: DataFrame, group: str = "doc_id") -> DataFrame:
    """`boxes` with row_rank: from the top, then from the left, then by index."""
    w = Window.partitionBy(group).orderBy("box.y0", "box.x0", "box_idx")
    return boxes.withColumn("row_rank", F.row_number().over(w) - 1)


def column_gaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """`boxes` with their place by centre, and the group's size, its widest gap and the place after it (the first of equals)."""
    w = Window.partitionBy(*keys).orderBy("centre", "box_idx")
    whole = Window.partitionBy(*keys)
    placed = boxes.withColumn("centre", (F.col("box.x0") + F.col("box.x1")) / 2).withColumn("place", F.row_number().over(w) - 1)
    placed = placed.withColumn("gap", F.col("centre") - F.lag("centre").over(w))
    best = F.max(F.when(F.col("gap") > 0, F.struct(F.col("gap").alias("gap"), (-F.col("place")).alias("at")))).over(whole)
    return placed.withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("best", best).withColumn("gap", F.coalesce("best.gap", F.lit(0.0))).withColumn("at", F.coalesce(-F.col("best.at"), F.lit(-1))).drop("best")


def column_major(boxes: DataFrame, group: str = "doc_id") -> DataFrame:
    """`boxes` with column_rank: groups split at their widest gap between columns, again and again, left before right.

    A group is split if it has four boxes or more, the gap is GAP or wider, and each side keeps two.
    """
    now = boxes.withColumn("path", F.lit("")).withColumn("open", F.lit(True))
    for _ in range(SPLITS):
        seen = column_gaps(now, [group, "path"])
        ok = F.col("open") & (F.col("members") >= LEAST) & (F.col("gap") >= GAP) & (F.col("at") >= 2) & (F.col("at") <= F.col("members") - 2)
        side = F.when(F.col("place") < F.col("at"), F.lit("0")).otherwise(F.lit("1"))
        now = seen.select(*boxes.columns, F.when(ok, F.concat("path", side)).otherwise(F.col("path")).alias("path"), ok.alias("open"))
    w = Window.partitionBy(group).orderBy(F.rpad("path", SPLITS, "0"), "box.y0", "box.x0", "box_idx")
    return now.withColumn("column_rank", F.row_number().over(w) - 1).drop("path", "open")
