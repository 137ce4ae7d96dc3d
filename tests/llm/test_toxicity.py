"""Toxicity: log ratios against a plain Kneser-Ney model, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from quire.llm.chargrams import BITS, normal
from quire.llm.toxicity import DISCOUNT, ORDER, ratios, score_toxicity, train

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxicity_note", T.StringType()), T.StructField("fold", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def number(gram):
    return sum(ord(c) << BITS * (len(gram) - 1 - i) for i, c in enumerate(gram))


def plain(texts):
    """{gram: ratio}, {context: ratio} of two texts by class, from the definition."""
    count = [Counter(t[i : i + ORDER] for t in of for i in range(len(t) - ORDER + 1)) for of in texts]
    kinds = set(count[0]) | set(count[1])
    types_of = {ORDER: kinds}
    for n in range(ORDER - 1, 0, -1):
        types_of[n] = {g[1:] for g in types_of[n + 1]}
    before = {n: Counter(g[1:] for g in types_of[n + 1]) for n in range(1, ORDER)}

    def continuation(g):
        n = len(g)
        if n == 1:
            v = len(types_of[1])
            return (max(before[1][g] - DISCOUNT, 0) + DISCOUNT * v / (v + 1)) / sum(before[1].values())
        own = [x for x in before[n] if x[:-1] == g[:-1]]
        return (max(before[n][g] - DISCOUNT, 0) + DISCOUNT * len(own) * continuation(g[1:])) / sum(before[n][x] for x in own)

    total, types = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for g, n in count[c].items():
            total[c][g[:-1]] += n
            types[c][g[:-1]] += 1

    def chance(c, g):
        shared, n = continuation(g[1:]), total[c][g[:-1]]
        return (max(count[c][g] - DISCOUNT, 0) + DISCOUNT * types[c][g[:-1]] * shared) / n if n else shared

    def weight(c, x):
        return DISCOUNT * types[c][x] / total[c][x] if total[c][x] else 1.0

    contexts = set(total[0]) | set(total[1])
    return {g: math.log(chance(1, g) / chance(0, g)) for g in kinds}, {x: math.log(weight(1, x) / weight(0, x)) for x in contexts}


def test_ratios_equal_plain(spark):
    rng = random.Random(6)
    texts = [[normal(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40))) for _ in range(3)] for _ in range(2)]
    rows = defaultdict(lambda: [0, 0])
    for c in (0, 1):
        for t in texts[c]:
            for i in range(len(t) - ORDER + 1):
                rows[t[i : i + ORDER]][c] += 1
    seen = spark.createDataFrame([(number(g), n[1], n[0]) for g, n in rows.items()], "gram bigint, toxic bigint, ordinary bigint")
    gram, context = ratios(seen)
    want_gram, want_context = plain(texts)
    for table, want in ((gram, want_gram), (context, want_context)):
        hit, value = table.of(np.array([number(g) for g in want], np.int64))
        assert hit.mean() > 0.99  # two keys may share a slot
        assert np.allclose(value[hit], np.array(list(want.values()))[hit], atol=1e-5)


def made(rng, toxic, n):
    words = ["".join(rng.choice(["ka", "lo", "mi", "ra", "tu"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vexgrob", "zwuxer", "grobzwu"]))
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, made(rng, i % 5 == 0, rng.choice([20, 200])), int(i % 5 == 0)) for i in range(1200)]
    labels = [(i, 1, y) for i, _, y in rows if i % 7] + [(None, 1, 1), (1, 1, None), (99_999, 1, 1), (2, 1, 0)]
    odd = [(5000, None), (5001, ""), (5002, " \n"), (None, "vexgrob zwuxer"), (5003, "kalo " * 250_000 + "vexgrob grobzwu zwuxer"), (5003, "twice"), (5003, "twice")]
    docs = spark.createDataFrame([(i, t, "n", "f") for i, t, _ in rows] + [(i, t, "n", "f") for i, t in odd], DOCS).repartition(3)
    model = train(docs.select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    out = score_toxicity(docs, model)
    assert out.columns == [*docs.columns, "toxicity", "toxic_predicted"]
    found = out.collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    held = [(r.toxic_predicted, truth[r.doc_id]) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.toxicity <= 1 and r.toxic_predicted == (r.toxicity >= 0.3) for r in found)
    clean = {r.toxicity for r in found if r.doc_id in (5000, 5001, 5002)}
    assert len(clean) == 1 and clean.pop() < 0.3
    assert [r.toxic_predicted for r in found if r.doc_id is None] == [1]
    assert score_toxicity(docs.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text", "", "")], DOCS)
    model = train(docs, spark.createDataFrame([], LABELS))
    assert [(r.toxicity, r.toxic_predicted) for r in score_toxicity(docs, model).collect()] == [(0.0, 0)]
    one_class = train(docs, spark.createDataFrame([(1, 1, 1)], LABELS))
    assert 0 <= score_toxicity(docs, one_class).first().toxicity <= 1


def test_sampled_classes_keep_their_shares(spark):
    rng = random.Random(9)

    def mixed(i):  # a word that both classes use, so that scores are not all at an end
        words = made(rng, False, 12).split()
        return " ".join(words + ["vexgrob"] * (rng.random() < (0.6 if i % 20 == 0 else 0.04)))

    docs = spark.createDataFrame([(i, mixed(i), "n", "f") for i in range(6000)], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i in range(6000)], LABELS)
    scores = []
    for max_rows in (200_000, 600):
        model = train(docs, labels, max_rows)
        x = model.score([r.text for r in docs.select("text").collect()])
        scores.append((model.base, x.mean(), x))
    (base, mean, _), (less, thin, _) = scores
    assert abs(base - less) < 0.02 and abs(mean - 0.05) < 0.02
    assert abs(mean - thin) < 0.03


def test_every_gram_is_kept(spark):
    slots = 2_097_143  # these keys once shared a slot
    rows = [(number("abcd") + k * slots, 50 if k == 3 else 1, 3 * k) for k in range(40)]
    gram, context = ratios(spark.createDataFrame(rows, "gram bigint, toxic bigint, ordinary bigint"))
    hit, value = gram.of(np.array([g for g, _, _ in rows] + [number("abcd") + 1, 0], np.int64))
    assert list(hit) == [True] * 40 + [False] * 2 and np.isfinite(value).all()
    assert context.of(np.array(sorted({g >> BITS for g, _, _ in rows})))[0].all()
    empty = ratios(spark.createDataFrame([], "gram bigint, toxic bigint, ordinary bigint"))[0]
    assert not empty.of(np.array([5, 6], np.int64))[0].any()


def test_given_names_and_clashes(spark):
    import pytest

    docs = spark.createDataFrame([(1, "text", 0.5)], "doc_id bigint, text string, toxicity double")
    model = train(docs, spark.createDataFrame([], LABELS))
    with pytest.raises(ValueError):
        score_toxicity(docs, model)
    row = score_toxicity(docs, model, into=("a", "b")).first()
    assert (row.toxicity, row.a, row.b) == (0.5, 0.0, 0)


def test_held_out_recall_and_precision_at_sf01(spark):
    """On fold 2 of the labels of sf0.1: recall 0.75, precision 0.8 at least (57 of its 449 toxic documents hold no word of their lexicon)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = score_toxicity(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2"), train(docs, labels))
    found = Counter((r.toxic, r.toxic_predicted) for r in held.select("toxic", "toxic_predicted").collect())
    assert found[1, 1] / (found[1, 1] + found[1, 0]) >= 0.75 and found[1, 1] / (found[1, 1] + found[0, 1]) >= 0.8, found
