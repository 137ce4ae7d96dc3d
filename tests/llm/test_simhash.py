"""SimHash groups against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import types as T

from quire.llm.simhash import fingerprint, simhash_groups

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def plain_fingerprint(text, n=3):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(grams))


def brute(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f, least.get(find(i))) for i, (d, f) in enumerate(prints)), key=str)


def made(rows):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows), key=str)


def test_fingerprint_cases():
    for text in (None, "", " \t\n", "one", "A b", "x y z", "É é É  a\x0bb", "w " * 70_000):
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(7000, None), (7001, ""), (7002, "  "), (None, "lone words here"), rows[0]]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert made(simhash_groups(docs).collect()) == brute(rows)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_similar(a, b, n=5):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) >= 0.8 * len(x | y)


def test_distinct_documents(spark):
    from quire.llm.neardup import distinct_documents

    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows, groups = [], {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 300, 600]))]
        for k in range(rng.choice([1, 2, 5])):
            copy = list(base)
            if k % 3 == 1 and len(base) >= 300:
                copy[rng.randrange(len(copy))] = "changed"
            text = " ".join(copy) if k % 2 == 0 else "  ".join(copy).upper()
            groups[len(rows)] = g
            rows.append((len(rows), text, "clash"))
    rows += [(900, None, "x"), (901, "", "x"), (902, " ", "x"), rows[0], (None, "all alone in here", "x"), (None, "all alone in here", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = distinct_documents(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and None in ids and 900 in ids and not {901, 902} & set(ids)
    text = {r[0]: r[1] for r in rows}
    for g in set(groups.values()):
        assert min(i for i in groups if groups[i] == g) in ids
    for i in groups:
        if i not in ids:
            assert any(groups[j] == groups[i] and j < i and plain_similar(text[i], text[j]) for j in groups)
    exact = [i for i in groups if i not in ids]
    assert all(i in exact for i in groups if any(j < i and text[j].lower().split() == text[i].lower().split() for j in groups))
    assert distinct_documents(docs.limit(0)).collect() == []


def test_repeats_do_not_hide_near_copies(spark):
    from quire.llm.neardup import distinct_documents

    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        line = words[:14]
        rows += [(2 * i, " ".join(words), ""), (2 * i + 1, " ".join(line * 20 + words), "")]
    assert all(plain_similar(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2]))
    kept = distinct_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 80, 2))


def test_texts_count_not_ids(spark):
    from quire.llm.neardup import distinct_documents

    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, ""), (None, b, ""), (None, b.upper(), ""), (7, c, ""), (7, d, ""), (8, d + " more", ""), (9, a + " more", ""), (10, e, "")]
    kept = distinct_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = [(None, a), (None, b), (7, c), (7, d), (10, e)]
    assert sorted(((r.doc_id, r.text.lower()) for r in kept), key=str) == sorted(want, key=str)


def test_recall_of_similar_pairs(spark):
    """Isolated pairs at a similarity from 0.8 on, of 6 to 300 shingles: of all pairs 0.9 and more are found."""
    from quire.llm.neardup import distinct_documents

    rng = random.Random(12)
    rows = []
    for i in range(240):
        n = rng.choice([10, 16, 30, 60, 120, 300])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b, last = list(a), a[:-1]
        while True:
            if rng.random() < 0.5:
                b = b[:-1]
            else:
                b[rng.randrange(len(b))] = f"w{rng.randrange(10**6)}"
            if not plain_similar(" ".join(a), " ".join(b)):
                break
            last = list(b)
            if rng.random() < 0.1:
                break
        b = last
        rows += [(2 * i, " ".join(a), ""), (2 * i + 1, " ".join(b), "")]
    assert all(plain_similar(x[1], y[1]) for x, y in zip(rows[::2], rows[1::2]))
    kept = {r.doc_id for r in distinct_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(range(0, 480, 2)) <= kept
    short = {2 * i + 1 for i in range(240) if len(rows[2 * i][1].split()) <= 36}
    assert not short & kept  # the least shingles of few miss nothing
    assert len(kept) - 240 <= 0.1 * (240 - len(short))


def components_of(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and plain_similar(texts[i], texts[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("unit", [(2048, 8192), (5, 11)])
def test_large_group_of_near_copies(spark, monkeypatch, unit):
    """Many near copies of one text, about half of them linked with none: groups equal those of all pairs."""
    from quire.llm import neardup

    monkeypatch.setattr(neardup, "UNIT", unit)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want = sorted(set(components_of(texts)))
    assert 10 < len(want) < 140
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    found = sorted(r.doc_id for r in neardup.distinct_documents(docs).collect())
    assert set(want) <= set(found) and len(found) <= 1.02 * len(want) + 1


def test_any_ids_and_clashing_columns(spark):
    from quire.llm.neardup import distinct_documents

    rows = [("b", "one two three", "n", 1, 2), ("a", "one  two THREE", "n", 3, 4), (None, None, "n", 5, 6), (None, "", "n", 5, 6), ("c", "long " * 30_000 + "end", "n", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, key string, h1 int, __n int")
    out = distinct_documents(docs)
    assert out.columns == docs.columns
    found = sorted((tuple(r) for r in out.collect()), key=str)
    assert {(r[0], r[3], r[4]) for r in found} == {("a", 3, 4), (None, 5, 6), ("c", 7, 8)} and len(found) == 3
