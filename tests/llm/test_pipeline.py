"""The pipeline: every stage's decisions take effect, on its own input."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from quire.llm.mixing import mixed_documents

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
BAD = ["vexgrob", "zwuxer", "grobzwu"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(20)
    folder = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ra", "tu", "se", "ni", "po"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, kinds = [], {}
    for i in range(600):
        words = [word() for _ in range(rng.choice([5, 40, 120]))]
        kind = "clean"
        if i % 6 == 0:
            kind = "toxic"
            for _ in range(4):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        elif i % 25 == 1:
            kind = "leak"
            words[3:3] = rng.choice(items)[1].split()
        elif i % 25 == 2 and i > 2:
            kind = "copy"
            words = rows[max(j for j in kinds if kinds[j] == "clean")][1].split()
        kinds[i] = kind
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", "c", None]), 0))
    rows = [(*r[:4], len(r[1])) for r in rows] + [(900, None, None, "a", None), (901, "", "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in kinds.items() if i % 8], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    outs, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        outs.append(docs.collect())
    return folder, rows, kinds, outs


def test_stages_keep_what_they_should(made):
    _, rows, kinds, outs = made
    columns = [f.name for f in DOCS]
    assert all(list(outs[k][0].__fields__) == columns for k in range(4))
    first = {r.doc_id for r in outs[0]}
    gone = {r[0] for r in rows} - first
    toxic = {i for i, k in kinds.items() if k == "toxic"}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 3
    text = {r[0]: r[1] for r in rows}
    words = lambda i: tuple((text[i] or "").lower().split())
    second = {r.doc_id for r in outs[1]}
    least = {}
    for i in sorted(first):
        least.setdefault(words(i), i)
    assert second <= set(least.values()) and len(set(least.values()) - second) <= 3
    third = {r.doc_id for r in outs[2]}
    leaks = {i for i, k in kinds.items() if k == "leak"}
    assert second - third == leaks & second


def test_mix_takes_its_budgets(made):
    _, _, _, outs = made
    size = lambda t: len((t or "").split())
    before, after = Counter(), Counter()
    for r in outs[2]:
        before[r.source] += size(r.text)
    for r in outs[3]:
        after[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), abs=len(before))
    text = {r.doc_id: r.text for r in outs[2]}
    times = Counter(r.doc_id for r in outs[3])
    assert max(times.values()) <= 2 and all(text[r.doc_id].startswith(r.text) for r in outs[3])
    assert sum(r.text != text[r.doc_id] for r in outs[3]) <= len(before)


def test_token_files_hold_the_mix(made):
    from tokenizers import Tokenizer

    _, _, _, outs = made
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in outs[3]:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in outs[4]) == want
    rows = sorted(outs[4], key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_run_equals_the_stages(spark, made):
    folder, _, _, outs = made
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(outs[4])


def test_parts_of_texts(spark):
    docs = spark.createDataFrame([(1, " a  b\tc\n", "en", "x", 8), (2, "d e", "en", "x", 3)], DOCS)
    out = mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in out) == 7
    assert all(r.text in (" a  b\tc\n", " a  b", " a", "d e", "d") for r in out)
    assert mixed_documents(docs.limit(0)).collect() == []
