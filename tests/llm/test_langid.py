"""Language identification: counts against a plain count, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from quire.llm.chargrams import BITS, batches, grams, inside, normal, pieces
from quire.llm.langid import BUCKETS, identify, train

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def sample(rng, lang, n):
    parts = {"en": ["the", "and", "ing", "th", "er"], "de": ["sch", "ung", "ein", "ö", "der"], "fr": ["eau", "tion", "é", "le", "qu"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_pieces_cover_long_texts(monkeypatch):
    from quire.llm import chargrams

    monkeypatch.setattr(chargrams, "STEP", 20)
    for text in ("a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh", "x" * 100, "x" * 50 + " y", "", None, "a " + "b" * 60 + " c d e f g h"):
        whole = normal(text)
        words = [w for p in pieces(whole) for w in p.split()]
        assert words == whole.split() and all(p[0] == p[-1] == " " for p in pieces(whole))


def test_grams_are_numbers_of_characters():
    ((owner, starts, codes),) = batches(["ab", None, "É漢"])
    assert owner.tolist() == [0, 2] and starts.tolist() == [0, 4]
    three = grams(codes, 3)[inside(codes, starts, 3)]
    assert three[0] == (ord(" ") << 2 * BITS) + (ord("a") << BITS) + ord("b") and len(three) == 4


def test_naive_bayes_equals_plain(spark):
    rng = random.Random(5)
    rows = [(i, sample(rng, lang, rng.choice([1, 3, 50])), lang) for i, lang in enumerate(["en", "de", "fr", "en"] * 30)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    model = train(docs)
    counts = {x: [Counter(), Counter()] for x in model.languages}
    for _, t, lang in rows:
        codes = [ord(c) for c in normal(t)]
        for k, n in enumerate((2, 3)):
            counts[lang][k].update(sum(c << BITS * (n - 1 - j) for j, c in enumerate(codes[i : i + n])) % BUCKETS for i in range(len(codes) - n + 1))
    prior = Counter(lang for *_, lang in rows)
    fresh = [(1000 + i, sample(rng, lang, 20), lang) for i, lang in enumerate(["en", "de", "fr"] * 10)]
    odd = [(2000, None, None), (2001, "", None), (2002, "12 34 !?", "en"), (None, "the and", None), (2003, "the " * 300_000, None)]
    found = identify(spark.createDataFrame([(*r, "") for r in fresh + odd], SCHEMA).repartition(2), model).collect()
    assert len(found) == len(fresh) + len(odd)
    by_id = {r.doc_id: r for r in found}
    for i, text, lang in fresh:
        total = []
        for x in model.languages:
            s = math.log(prior[x] / len(rows))
            codes = [ord(c) for c in normal(text)]
            for k, n in enumerate((2, 3)):
                of = sum(counts[x][k].values()) + 0.5 * BUCKETS
                s += sum(math.log((counts[x][k][sum(c << BITS * (n - 1 - j) for j, c in enumerate(codes[p : p + n])) % BUCKETS] + 0.5) / of) for p in range(len(codes) - n + 1))
            total.append(s)
        total = np.array(total)
        assert by_id[i].lang_pred == model.languages[int(total.argmax())] == lang
        assert abs(by_id[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-3
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert by_id[None].lang_pred == "en" and by_id[2003].lang_pred == "en"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None, ""), (2, None, "en", "")], SCHEMA)
    model = train(docs)
    assert [(r.lang_pred, r.score) for r in identify(docs, model).collect()] == [("und", 0.0)] * 2
    assert identify(docs.limit(0), model).collect() == []
