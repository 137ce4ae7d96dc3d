"""Layout relations derived from the text tables by closed-form arithmetic, in Spark and in DuckDB SQL.

No engine can render pages here, so that each document is taken for a page, each of its lines for a detected box. The
two forms use the same double operations in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(v: Column) -> Column:
    """Six decimals by the same IEEE operations in both engines."""
    return F.floor(v * 1e6 + 0.5) / 1e6


def line_arrays(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.lines(F.col("text")).alias("lines"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_idx, text)."""
    return line_arrays(docs).select("doc_id", F.posexplode("lines").alias("line_idx", "text"))


def box_of(d: Column, i: Column, n: Column) -> Column:
    """The box of line i of n: one column or two, widths by a rule, every fifth box as thin as a rule."""
    rows = F.when((n >= 6) & (d % 2 == 0), (n + 1 - (n + 1) % 2) / 2).otherwise(n).cast("int")
    r = (i % rows).cast("int")
    c = ((i - r) / rows).cast("int")
    x0 = F.lit(0.05) + F.lit(0.48) * c
    y0 = F.lit(0.04) + F.lit(0.92) * r / rows
    w = F.lit(0.10) + F.lit(0.32) * ((d * 31 + i * 17) % 7) / F.lit(6.0)
    h = F.when(i % 5 == 4, F.lit(0.004)).otherwise(F.lit(0.92) / rows * F.lit(0.8))
    return G.box(x0, y0, x0 + w, y0 + h)


def boxes(docs: DataFrame) -> DataFrame:
    """(doc_id, box_idx, n, box, text): one for each line."""
    of = line_arrays(docs).select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("box_idx", "text"))
    return of.withColumn("box", box_of(F.col("doc_id"), F.col("box_idx"), F.col("n")))


def predictions(found: DataFrame) -> DataFrame:
    """(doc_id, box_idx, box, text): boxes moved a little, every seventh missing, some letters misread."""
    shift = ((F.col("doc_id") + F.col("box_idx")) % 4) * F.lit(0.01)
    b = F.col("box")
    moved = G.box(b["x0"] + shift, b["y0"] + shift, b["x1"] + shift, b["y1"] + shift)
    misread = F.when((F.col("doc_id") + F.col("box_idx")) % 3 == 0, F.replace("text", F.lit("e"), F.lit("a"))).otherwise(F.col("text"))
    return found.where("box_idx % 7 <> 3").select("doc_id", "box_idx", moved.alias("box"), misread.alias("text"))


SPACE = X.SPACE
STRIP = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
LINES_OF = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {STRIP('s')}), lambda s: s <> '')"

SQL = f"""
page_lines AS (SELECT doc_id, {LINES_OF("text")} AS lines FROM documents),
v_lines AS (SELECT doc_id, len(lines) AS n, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_idx, unnest(lines) AS text FROM page_lines),
v_grid AS (
  SELECT *, line_idx AS i, CASE WHEN n >= 6 AND doc_id % 2 = 0 THEN (n + 1) // 2 ELSE n END AS rws FROM v_lines),
v_place AS (
  SELECT *, i % rws AS r, i // rws AS c FROM v_grid),
v_corner AS (
  SELECT *, 0.05::DOUBLE + 0.48::DOUBLE * c AS x0, 0.04::DOUBLE + 0.92::DOUBLE * r / rws AS y0,
         0.10::DOUBLE + 0.32::DOUBLE * ((31 * doc_id + 17 * i) % 7) / 6.0::DOUBLE AS w,
         CASE WHEN i % 5 = 4 THEN 0.004::DOUBLE ELSE 0.92::DOUBLE / rws * 0.8::DOUBLE END AS h FROM v_place),
v_boxes AS (SELECT doc_id, i AS box_idx, n, text, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM v_corner),
v_pred AS (
  SELECT doc_id, box_idx, x0 + s AS x0, y0 + s AS y0, x1 + s AS x1, y1 + s AS y1,
         CASE WHEN (doc_id + box_idx) % 3 = 0 THEN replace(text, 'e', 'a') ELSE text END AS text
  FROM (SELECT *, ((doc_id + box_idx) % 4) * 0.01::DOUBLE AS s FROM v_boxes WHERE box_idx % 7 <> 3))
"""


def sql(select: str, more: str = "", recursive: bool = False) -> str:
    """A query over the derived relations, and further ones."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{', ' + more.strip() if more else ''} {select.strip()}"


def SIX(x: str) -> str:  # noqa: N802
    return f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
