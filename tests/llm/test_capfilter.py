"""Cap filters against all pairs."""

import math

import numpy as np
from pyspark.sql import types as T

from quire.llm.capfilter import SKETCH, decode, near_vectors, sketch

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType())])


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_decode_lists_every_filter():
    from quire.llm import capfilter

    x = unit(np.random.default_rng(1).standard_normal((20, 7)))
    turn, left, right, _ = capfilter.code(7)
    y = x @ turn
    for v, found in zip(y, decode(x, 1.1)):
        value = (left @ v[:4])[:, None] + (right @ v[4:])[None]
        assert sorted(found) == list(np.flatnonzero(value.ravel() >= 1.1 * math.sqrt(2 / 7)))


def test_recall_at_the_limit():
    rng = np.random.default_rng(2)
    a = unit(rng.standard_normal((2000, 64)))
    z = rng.standard_normal(a.shape)
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * z
    alike = [(int(p) ^ int(q)) & (2**64 - 1) for p, q in zip(sketch(a), sketch(b))]
    shared = [bool(np.intersect1d(p, q).size) and x.bit_count() <= SKETCH for p, q, x in zip(decode(a), decode(b), alike)]
    assert np.mean(shared) >= 0.95


def brute(rows):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    root, degree = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
                v, w = np.array(v, np.float64), np.array(w, np.float64)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                    degree[i] += 1
                    degree[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], degree[i], least.get(find(i)), r[0] is not None and least.get(find(i)) == r[0]) for i, r in enumerate(rows)), key=str)


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2, 3):
        for _ in range(25):
            base = rng.standard_normal(32)
            for spread in rng.choice([0, 0.05, 0.1, 0.6], rng.integers(1, 5)):
                v = (base + spread * rng.standard_normal(32)).astype(np.float32)
                rows.append((len(rows) * 3, [float(x) for x in v], label))
    rows += [(900, rows[0][1], 1), (901, rows[0][1], 2), (902, rows[0][1], None), (903, None, 1), (904, [], 1), (905, [0.0] * 32, 1)]
    rows += [(906, [float("nan")] + [1.0] * 31, 1), (907, [float("inf")] + [1.0] * 31, 1), (908, [None] + [1.0] * 31, 1), (None, rows[3][1], 1), (0, rows[5][1], 1)]
    rows += [(910, [2.0, 0.0], 1), (911, [3.0, -0.0], 1), (912, [1e-38, 0.0], 1), (913, [1.0], 1), (914, [1e38] * 3, 1), (915, [3e38] * 3, 1), rows[0]]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table, reach=2.2).collect()), key=str)
    assert found == brute(rows)
    assert near_vectors(table.limit(0)).collect() == []
