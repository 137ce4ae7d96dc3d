"""The mix against its own rules: targets by water level, exact budgets, reruns."""

import hashlib
import random

from pyspark.sql import types as T

from quire.llm.mixing import mix_sources

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("size", T.StringType())])


def plain(rows):
    size = lambda t: len((t or "").encode().split())
    own = {}
    for d, t, s in rows:
        own[s] = own.get(s, 0) + size(t)
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), 1.5 * sum(own.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * own[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 2.0 * own[s]
            budget -= target[s]
        left -= over
    out = []
    for s in names:
        key = lambda x: (hashlib.md5(f"mix-1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, size(x[1]))
        budget = int(target[s])
        epochs = budget // own[s] if own[s] else 0
        rest = budget - epochs * own[s]
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = size(t)
            out.append((d, n, own[s], round(target[s], 6), epochs * n + max(0, min(rest, n))))
            rest -= n
    return sorted(out, key=str)


def test_mix_equals_plain(spark):
    rng = random.Random(3)
    sources = ["a", "b", "B", "é", None, "hot", "hot", "hot", ""]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(sources)) for i in range(300)]
    rows += [(400, None, "a"), (401, "x\x0by z", "b"), (None, "no id at all", "a"), rows[5], rows[5], (500, "", "empty")]
    rows += [(600, "long " * 50_000, "hot")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    for per_range in (7, 2048):
        found = mix_sources(docs, rows_per_range=per_range).collect()
        assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found), key=str) == plain(rows)
    taken = {}
    for r in found:
        taken[(r.source_size, r.target)] = taken.get((r.source_size, r.target), 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(n == int(t) for (_, t), n in taken.items())


def test_empty_and_no_words(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = mix_sources(spark.createDataFrame([(1, " ", "a", "", "")], SCHEMA)).collect()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)
