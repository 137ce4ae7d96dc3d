"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: a vector, turned at random, is cut into two halves, each half
has DIRECTIONS random unit directions of its own, and every pair of them is a filter. A vector is list-decoded to all
filters whose inner product with it exceeds a threshold: for a direction of the first half, the second half's
directions that still reach the threshold are a prefix of its sorted list. Vectors that share a filter are candidates,
and each candidate pair is verified in double precision.

Candidates first compare 64-bit sign sketches, which travel with the filters, so that few vectors have to be moved.

Equal vectors of a label are one node, so copies are never paired. Recall against brute force is tested: with 64
components a vector has about 54 filters, and of pairs just at cosine 0.98, the hardest ones, 0.99 share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import connected_components, written

DIRECTIONS = 512
#: In standard deviations of a random direction's inner product.
REACH = 3.4
#: A cosine that always suffices; it counts where vectors have few components and no direction is that far off.
CLOSE = 0.425
#: Bits by which the sign sketches of a candidate pair may differ: 4 are expected at cosine 0.98, with a deviation of 2.
SKETCH = 16


@cache
def code(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turn, the directions of both halves and those of the sketch, for vectors of length d; the same on every machine."""
    rng = np.random.Generator(np.random.PCG64(977 * d + 5))
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    halves = [rng.standard_normal((DIRECTIONS, k)) for k in (d - d // 2, d // 2)]
    signs = rng.standard_normal((d, 64))
    return turn, *(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in halves), signs


def decode(unit: np.ndarray, reach: float = REACH) -> list[np.ndarray]:
    """For each unit vector, the numbers of all filters that exceed the threshold."""
    d = unit.shape[1]
    turn, left, right, _ = code(d)
    x = unit @ turn
    a, b = x[:, : d - d // 2] @ left.T, x[:, d - d // 2 :] @ right.T
    least = min(reach / np.sqrt(d), CLOSE) * np.sqrt(2.0)  # a pair of unit directions is sqrt(2) long
    order = np.argsort(-b, axis=1, kind="stable")
    sorted_b = np.take_along_axis(b, order, axis=1)
    out = []
    for i in range(len(x)):
        firsts = np.flatnonzero(a[i] + sorted_b[i, 0] >= least)
        ends = np.searchsorted(-sorted_b[i], a[i, firsts] - least, "right")
        out.append(np.concatenate([f * DIRECTIONS + order[i, :n] for f, n in zip(firsts, ends)] or [np.zeros(0, np.int64)]))
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    bits = x @ code(x.shape[1])[3] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]


def near_vectors(table: DataFrame, least: float = 0.98, reach: float = REACH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows are compared if labels are equal and not null and vectors equally long. Vectors that are null, empty or zero,
    or that hold null or non-finite components, link with nothing. Rows that repeat an id are separate vectors; a
    component's id is the least one in it, null only if it has none. Other columns are ignored; empty gives empty.
    """
    rows = table.select("vec_id", "embedding", "label")
    sound = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    # -0.0 and 0.0 are one value here
    vector = F.expr(f"if({sound}, transform(embedding, x -> double(x) + 0.0D), null)").alias("vector")
    rows = written(rows.select("vec_id", "label", vector), "vectors")
    classes = written(
        rows.where("vector is not null")
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )

    def filters(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, labels, lists = batch.column(0), batch.column(1), batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                for own in np.array_split(np.flatnonzero(sizes == d), max(1, (sizes == d).sum() // 1024)):
                    x = flat[starts[own][:, None] + np.arange(d)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    found = decode(x / np.linalg.norm(x, axis=1, keepdims=True), reach)
                    times = [len(f) for f in found]
                    at, marks = pa.array(np.repeat(own, times)), pa.array(np.repeat(sketch(x), times))
                    both = pa.array(np.concatenate(found) + (int(d) << 32))
                    yield pa.RecordBatch.from_arrays([nodes.take(at), labels.take(at), both, marks], ["node", "label", "filter", "sketch"])

    kind = table.schema["label"].dataType.simpleString()
    met = written(classes.select("node", "label", "vector").mapInArrow(filters, f"node bigint, label {kind}, filter bigint, sketch bigint"), "filters")
    other = met.select(F.col("node").alias("other"), "label", "filter", F.col("sketch").alias("other_sketch"))
    pairs = met.join(other, ["label", "filter"]).where(f"node < other and bit_count(sketch ^ other_sketch) <= {SKETCH}").select("node", "other").distinct()
    vectors = classes.select(F.col("node").alias("id"), "vector")
    met = pairs.join(vectors.select(F.col("id").alias("node"), F.col("vector").alias("a")), "node").join(
        vectors.select(F.col("id").alias("other"), F.col("vector").alias("b")), "other"
    )

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            starts = batch.column(2).offsets.to_numpy()
            starts = (starts - starts[0])[:-1]
            if not len(starts):
                continue
            total = lambda z: np.add.reduceat(z, starts)
            # scaled first, so that no square overflows
            each = np.diff(np.append(starts, len(x)))
            x = x / np.repeat(np.maximum.reduceat(np.abs(x), starts), each)
            y = y / np.repeat(np.maximum.reduceat(np.abs(y), starts), each)
            near = total(x * y) / (np.sqrt(total(x * x)) * np.sqrt(total(y * y))) >= least
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    found = written(met.select("node", "other", "a", "b").mapInArrow(verify, "a bigint, b bigint"), "links")
    groups = connected_components(found)
    copies = classes.select(F.col("node").alias("b"), "copies")
    ways = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    named = (
        classes.join(groups.select("node", F.col("component").alias("root")), "node", "left")
        .join(linked.select(F.col("a").alias("node"), "others"), "node", "left")
        .select("label", "vector", "least_id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "root").select("label", "vector", "n_links", "component_id")
    out = rows.where("vector is not null").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (
  SELECT a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98::DOUBLE),
reach AS (SELECT n, n AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m),
least AS (SELECT r.n, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.m GROUP BY r.n),
degree AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (n) LEFT JOIN degree USING (n)
"""
