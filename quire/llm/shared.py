"""What several corpus operators need: the shared folder, tables that cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary folder where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows in an Arrow batch: whole texts are long, and batches take memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: later stages read it, so a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least(by: str, *more: str) -> Column:
    """Of the row with the least `by` in a group, these columns as a struct. Unlike the least struct, this needs no sort."""
    return F.struct(F.min(by).alias(by), *(F.min_by(c, by).alias(c) for c in more))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a text, h1 and h2; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (a long, b long): (node, component), component being its least node.

    Alternates large-star and small-star steps, each of which is grouped minima joined back to the edges. The minima
    are shuffled again for the join, since only then can Spark split a hub's edges over tasks (adaptive skew join).
    Nodes are those with an edge to another node; nulls have none. Rounds grow with the logarithm of the longest path.
    """

    def apart(least: DataFrame) -> DataFrame:
        return least.select((F.col("a") + F.lit(0)).alias("of"), "m")

    def mark(table: DataFrame) -> tuple:
        row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        return tuple(row)

    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(apart(least), F.col("a") == F.col("of"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(apart(least), F.col("a") == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(met.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        marked = mark(after)
        now, same = after, marked == seen
        seen = marked
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
