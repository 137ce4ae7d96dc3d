"""Language identification: multinomial naive Bayes over hashed character n-grams.

Bigrams and trigrams of lower-cased text are counted by language in BUCKETS buckets each. The matrix of log
probabilities (buckets by languages, float32) is broadcast: its size is 2 * BUCKETS * 4 bytes for each language. A
batch is scored by looking up only the rows of the buckets that occur and adding them up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.chargrams import batches, grams, inside
from quire.llm.shared import text_batches

BUCKETS = 65_521  # a prime
ORDERS = (2, 3)
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def bucketed(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each position, and the last bucket where there is none."""
    out = []
    for k, n in enumerate(ORDERS):
        found = grams(codes, n) % BUCKETS + k * BUCKETS
        found[~inside(codes, starts, n)] = len(ORDERS) * BUCKETS
        out.append(found)
    return out


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (len(ORDERS) * BUCKETS + 1, languages); the last row is zero
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total = np.tile(self.prior, (len(texts), 1)).astype(np.float64)
        for owner, starts, codes in batches(texts):
            for found in bucketed(codes, starts):
                np.add.at(total, owner, np.add.reduceat(self.matrix[found], starts, axis=0))
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, chance, 0.0)


def train(docs: DataFrame, max_docs: int = 20_000, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits on the rows of `docs` with a text and a language, or on a hash sample of about `max_docs` of them.

    Whole texts count. Counts are summed by Spark; the driver gets one row per language and bucket.
    """
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(lang_col).count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_docs / n)))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ORDERS) * BUCKETS + 1
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in it:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                to = held.setdefault(lang, np.zeros(size, np.int64))
                seen[lang] = seen.get(lang, 0) + len(own)
                for _, starts, codes in batches(own):
                    for found in bucketed(codes, starts):
                        to += np.bincount(found, minlength=size)
        for lang, to in held.items():
            to[-1] = seen[lang]  # the last bucket carries the number of texts
            at = np.flatnonzero(to)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(to[at])], ["lang", "bucket", "n"])

    counted = rows.select(F.col(text_col), F.col(lang_col)).mapInArrow(count, "lang string, bucket int, n bigint")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(ORDERS) * BUCKETS + 1, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    counts[got.column("bucket").to_numpy(), np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)] = got.column("n").to_numpy()
    prior = np.log(counts[-1] / counts[-1].sum()) if languages else np.zeros(0)
    matrix = np.zeros(counts.shape, np.float32)
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS : (k + 1) * BUCKETS] + smoothing
        matrix[k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(axis=0))
    return Model(languages, matrix, prior)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs`; score is the posterior of lang_pred.

    `und` with score 0 if the text is null or has no letter, or if no language was learned. Ties go to the first
    language by name. Repeated rows come out as often as they came in; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                names, scores = shared.value.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")
