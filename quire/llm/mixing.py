"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key, which is uniform, so that its leading bits cut each source into ranges of about
`rows_per_range` rows, however large the source. Sizes are summed by range, the sums are accumulated over a source's
ranges, and a window inside each range adds the rows' own prefix sums: no task ever holds a source. The mix takes whole
epochs of a source and then its rows in key order up to the exact budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """(source, n, source_size, target) from (source, size).

    Sources by code point, null last, take `weights` in turn and share `share` of all sizes; no target is above `most`
    times its source's size. What a full source leaves over goes to the others by weight until none is above. That
    level is found in one pass: sources are ordered by size over weight, and the first that stays below its limit,
    when all before it are full, sets the level. This window sees one row per source.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    ranked = (
        sizes.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", w.cast("bigint"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * most).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(float(share)) * F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("below", F.col("level") * F.col("weight") <= F.col("source_size") * most)
        .withColumn("fill", F.row_number().over(by_fill))
        .withColumn("first_below", F.min(F.when(F.col("below"), F.col("fill"))).over(everything))
        .withColumn("final", F.min(F.when(F.col("fill") == F.col("first_below"), F.col("level"))).over(everything))
    )
    limit = (F.col("source_size") * most).cast("double")
    full = F.col("first_below").isNull() | (F.col("fill") < F.col("first_below"))
    return ranked.select(
        "source", "n", "source_size", F.when(full, limit).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix-1",
    carry: bool = False,
    rows_per_range: int = 2048,
    tie: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of every row; 0 where it takes nothing.

    With `carry`, a struct `row` holds the row's own columns as well.

    taken counts words, repeats included: whole epochs of the source, and once more what still fits when rows are
    taken by md5(seed, id), id, size and `tie`, a number which also stands for a null id. The last row may be taken in part, so that a source's taken words are its
    target rounded down. Reruns agree. Null sources are one source, the last; a null id hashes as an empty one; rows
    that repeat count as often as they come; empty texts take nothing; an empty table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    kept = [F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []
    tie = F.lit(None).cast("bigint") if tie is None else tie
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), tie.cast("string")), F.lit("")))).alias("key"),
        tie.alias("tie"),
        *kept,
    )
    # a table, so that its size is known when the join is planned: small ones are broadcast, and no row moves by source
    targets = written(source_targets(rows.select("source", "size"), weights, share, most), "targets")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    dealt = (
        rows.select("*", name)
        .join(targets.select(name, "n", "source_size", "target"), "name")
        .withColumn("ranges", F.ceil(F.col("n") / rows_per_range))
        .withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.col("ranges") / (1 << 32)))
    )
    before_part = (
        dealt.groupBy("name", "part")
        .agg(F.sum("size").alias("in_part"))
        .withColumn("base", F.sum("in_part").over(Window.partitionBy("name").orderBy("part")) - F.col("in_part"))
        .select("name", "part", "base")
    )
    inside = Window.partitionBy("name", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(before_part, ["name", "part"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("base") - F.col("inside")
    taken = epochs * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *(["row"] if carry else [])
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The mix as rows of `docs`, all columns: a row for each epoch that takes a whole text, and one for a part of it.

    A part is the text's first words with the white space before them; `length_col`, if there is one, is its length.
    Rows that the mix does not take are gone, and so are those without words.
    """
    found = mix_sources(docs, id_col, source_col, word_count(F.col(text_col)), carry=True, tie=F.xxhash64(text_col)).where("taken > 0")
    words = F.expr("cast(array_repeat(0L, cast(taken div size as int)) || if(taken % size > 0, array(taken % size), array()) as array<bigint>)")
    found = found.select("row", F.explode(words).alias("first"))
    start = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("first").cast("int")), "")
    text = F.when(F.col("first") > 0, start).otherwise(F.col(f"row.{text_col}"))
    kinds = dict(docs.dtypes)
    own = {text_col: text}
    if length_col in docs.columns:
        own[length_col] = F.when(F.col("first") > 0, F.length(start)).otherwise(F.col(f"row.{length_col}"))
    return found.select(*(own.get(c, F.col(f"row.{c}")).cast(kinds[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, coalesce('=' || source, '') AS name, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
ranked AS (
  SELECT name, source_size, rank, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM (SELECT name, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
        FROM (SELECT name, source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY ALL))),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
         CAST(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left,
         row_number() OVER (ORDER BY source_size / weight, rank) AS fill
  FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * total - full_before) / weight_left AS level FROM filled),
firsts AS (SELECT min(fill) AS first_below FROM levels WHERE level * weight <= source_size * 2),
targets AS (
  SELECT name, source_size,
         CASE WHEN first_below IS NULL OR fill < first_below THEN CAST(source_size * 2 AS DOUBLE)
              ELSE (SELECT level FROM levels l2 WHERE l2.fill = first_below) * weight END AS target
  FROM levels CROSS JOIN firsts),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY name ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before,
  FROM rows_ JOIN targets USING (name)),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM cut
"""
