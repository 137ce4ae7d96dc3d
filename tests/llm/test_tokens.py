"""Token files against the library called on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from quire.llm.tokens import read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n", T.IntegerType())])
TEXTS = [
    "plain words here, and more. I'm here's it'll",
    None,
    "",
    " ",
    "  two  spaces ",
    "line\nbreak \n and\ttab \t end  x y \x1c z",
    "a <|endoftext|> b<|endoftext|>c  <|endoftext|>",
    "über naïve 漢字 🙂 12 345 a1b2 ''s ' s",
    "word " * 5000,
    "x" * 20_000,
    "plain words here, and more. I'm here's it'll",
]


def plain(rows):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    coded = [(d, made.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    for d, ids in sorted(coded, key=lambda x: (x[0] is None, x[0] or 0, len(x[1]), np.array(x[1], "<u2").tobytes())):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_files_equal_whole_texts(spark, shards):
    rows = [((i * 7) % 11, t) for i, t in enumerate(TEXTS)] + [(3, "repeat"), (3, "repeat"), (None, "no id"), (-5, "negative")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(4)
    found = [tuple(x) for x in read_tokens(write_tokens(docs, VOCABULARY, shards=shards)).collect()]
    key = lambda x: x[1]
    assert sorted(found, key=key) == plain(rows)


def test_empty_table(spark):
    assert read_tokens(write_tokens(spark.createDataFrame([], SCHEMA), VOCABULARY)).collect() == []
