"""Toxicity by two class-conditional Kneser-Ney character models with shared backoff.

The toxic and the ordinary model count 4-grams of their own class, within words, whose ends count as characters. Both
back off to one shared distribution: Kneser-Ney continuation counts over both classes, interpolated down to single
characters. An expression that a class has not seen counts by its context and by what both classes share; where neither
has seen it, the shared part cancels out of the ratio and only the two backoff weights remain. What scoring needs is thus
one number for each seen 4-gram and one for each seen context, log P(toxic model) - log P(ordinary model), kept in two
tables of as many rows as there are keys.

The two log-likelihoods are compared divided by length, in characters: for each word, and for the whole text. A text's
features are its largest ratio of a word, how far and for how many characters its words' ratios exceed MARGIN, and the
ratio of the whole text, which alone would let long texts drown what they contain. A logistic curve of them, fitted on
labelled rows that the models have not counted, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.chargrams import BITS, batches, grams, inside
from quire.llm.langid import fold
from quire.llm.shared import text_batches, written

ORDER = 4
DISCOUNT = 0.75
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A word's log ratio by character counts as an excess above this.
MARGIN = 0.3


@dataclass
class Ratios:
    """Log ratios of all keys, in buckets by a hash; a key takes 12 bytes, and 8 to 16 more for the buckets' starts."""

    first: np.ndarray  # of each bucket, and the end
    key: np.ndarray
    value: np.ndarray

    @staticmethod
    def made(key: np.ndarray, value: np.ndarray) -> Ratios:
        buckets = 1 << max(1, (2 * len(key)).bit_length())
        own = Ratios.bucket(key, buckets)
        order = np.lexsort([key, own])
        first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=buckets))]).astype(np.uint32)
        return Ratios(first, key[order], value[order].astype(np.float32))

    @staticmethod
    def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return (keys.astype(np.uint64) * MULTIPLIER >> np.uint64(65 - buckets.bit_length())).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, value = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        own = self.bucket(keys, len(self.first) - 1)
        at, end = self.first[own], self.first[own + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            same = self.key[at] == wanted
            hit[left[same]] = True
            value[left[same]] = self.value[at[same]]
            more = ~same & (at + 1 < end)
            left, at, end, wanted = left[more], at[more] + 1, end[more], wanted[more]
        return hit, value


@dataclass
class Model:
    gram: Ratios
    context: Ratios
    weights: np.ndarray | None  # for 1 and the features; None: nothing to tell the classes apart
    base: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: its largest log ratio of a word, by character; its words' excess over MARGIN; its own ratio by character."""
        out = np.zeros((len(texts), 3))
        length = np.ones(len(texts))
        for owner, starts, codes in batches(texts, ORDER - 1):
            keys = grams(codes, ORDER)
            hit, ratio = self.gram.of(keys)
            near, weight = self.context.of(keys >> BITS)
            ratio = np.where(hit, ratio, np.where(near, weight, 0)).astype(np.float64)
            ratio[~inside(codes, starts, ORDER)] = 0
            first = np.zeros(len(codes), bool)
            first[1:] = (codes[:-1] == 32) & (codes[1:] != 32)
            first[starts] = True
            words = np.flatnonzero(first)
            by_word = np.add.reduceat(ratio, words)
            letters = np.maximum(np.diff(np.append(words, len(codes))) - (ORDER - 2), 1)  # and one end
            own = np.searchsorted(words, starts)
            np.maximum.at(out[:, 0], owner, np.maximum.reduceat(by_word / letters, own))
            np.add.at(out[:, 1], owner, np.add.reduceat(np.maximum(by_word - MARGIN * letters, 0), own))
            np.add.at(out[:, 2], owner, np.add.reduceat(by_word, own))
            np.add.at(length, owner, np.diff(np.append(starts, len(codes))))
        out[:, 2] /= length
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        return curve(shaped(self.features(texts)) @ self.weights)


def shaped(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1]), x[:, 2] * 10], axis=1)


def curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fitted(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, rows counting `count` times; a feature that would count against toxicity is left out."""
    on = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[on] = newton(x[:, on], y, count, ridge)
        if not (against := (w[1:] < 0)).any():
            return w
        on[1 + int(np.argmin(np.where(against, w[1:], 0)))] = False


def newton(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = curve(x @ w)
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (count * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, fold, toxic, stands_for) of at most `max_rows` labelled rows of folds 0, 1 and 3, half of each class at most.

    `stands_for` is the class's count over that of its sample, so that weighted rows have the class shares of all labels. Rows are chosen by a hash of their id; an id with several labels is toxic if any of them says so. The chosen ids
    are at most `max_rows` pairs of numbers, which is what is broadcast.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", fold(F.col("doc_id")).alias("fold")).where("fold <> 2")
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id"]
    classes = ("toxic > 0", "toxic <= 0")
    counts = known.agg(*(F.count_if(F.expr(what)) for what in classes)).first()
    share = [max(1.0, n / max(1, max_rows // 2)) for n in counts]
    chosen = [known.where(what).orderBy(*order).limit(max_rows // 2).withColumn("stands_for", F.lit(x)) for what, x in zip(classes, share)]
    chosen = written(chosen[0].unionByName(chosen[1]), "labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "fold", (F.col("toxic") > 0).cast("int").alias("toxic"), "stands_for")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000) -> Model:
    """Counts folds 0 and 1 of the labelled rows, and fits the curve on fold 3; fold 2 is never looked at."""
    text_batches(docs.sparkSession)
    rows = labelled(docs, labels, max_rows)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(keys, by_class):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(by_class[1]), pa.array(by_class[0])], ["gram", "toxic", "ordinary"])

        held, n = ([], []), 0

        def made():
            keys = [np.unique(np.concatenate([np.zeros(0, np.int64), *x]), return_counts=True) for x in held]
            both = np.union1d(keys[0][0], keys[1][0])
            counts = [np.zeros(len(both), np.int64) for _ in keys]
            for to, (k, c) in zip(counts, keys):
                to[np.searchsorted(both, k)] = c
            return row(both, counts)

        for batch in it:
            texts, classes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for which in (0, 1):
                for _, starts, codes in batches([t for t, c in zip(texts, classes) if c == which], ORDER - 1):
                    found = grams(codes, ORDER)[inside(codes, starts, ORDER)]
                    held[which].append(found)
                    n += len(found)
                    if n > 8_000_000:
                        yield made()
                        held, n = ([], []), 0
        if n:
            yield made()

    counted = rows.where("fold <> 3").select("text", "toxic").mapInArrow(count, "gram bigint, toxic bigint, ordinary bigint")
    seen = written(counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    gram, context = ratios(seen)
    empty = Model(gram, context, None, 0.0)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(empty)

    def feature(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = shared.value.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x[:, i]) for i in range(3))], ["toxic", "stands_for", "a", "b", "c"])

    got = rows.where("fold = 3").select("text", "toxic", "stands_for").mapInArrow(feature, "toxic int, stands_for double, a double, b double, c double").toArrow()
    y = got.column("toxic").to_numpy().astype(np.float64)
    count = got.column("stands_for").to_numpy()
    base = float(np.average(y, weights=count)) if len(y) else 0.0
    if not len(y) or y.min() == y.max() or not len(gram.key):
        return Model(gram, context, None, base)
    x = np.stack([got.column(c).to_numpy() for c in "abc"], axis=1)
    order = np.lexsort([*x.T, count, y])  # the same sums whatever the order of arrival
    return Model(gram, context, fitted(shaped(x[order]), y[order], count[order]), base)


def ratios(seen: DataFrame) -> tuple[Ratios, Ratios]:
    """The two tables, from (gram, toxic, ordinary): one row a key comes to the driver."""
    contexts = seen.groupBy(F.shiftright("gram", BITS).alias("context")).agg(
        F.sum("toxic").alias("n1"), F.count_if(F.col("toxic") > 0).alias("k1"),
        F.sum("ordinary").alias("n0"), F.count_if(F.col("ordinary") > 0).alias("k0"),
    )
    low = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << BITS * n) - 1))

    def continuations(longer: DataFrame, n: int) -> DataFrame:
        """(key, p): the shared distribution of the last of n characters, from the distinct grams of n + 1."""
        types = longer.groupBy(low("key", n).alias("key")).agg(F.count(F.lit(1)).alias("before"))
        above = F.greatest(F.col("before") - DISCOUNT, F.lit(0.0))
        if n == 1:
            all_types = types.agg(F.sum("before").alias("total"), F.count(F.lit(1)).alias("kinds"))
            return types.join(F.broadcast(all_types)).select("key", ((above + DISCOUNT * F.col("kinds") / (F.col("kinds") + 1)) / F.col("total")).alias("p"))
        contexts = types.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("before").alias("total"), F.count(F.lit(1)).alias("kinds"))
        shorter = continuations(types.select("key"), n - 1).select(F.col("key").alias("end"), F.col("p").alias("shorter"))
        both = types.join(contexts, F.shiftright("key", BITS) == F.col("context")).join(shorter, low("key", n - 1) == F.col("end"))
        return both.select("key", ((above + DISCOUNT * F.col("kinds") * F.col("shorter")) / F.col("total")).alias("p"))

    shared = written(continuations(seen.select(F.col("gram").alias("key")), ORDER - 1), "shared")

    def chance(n: str, of: str, kinds: str):
        known = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("p")) / F.col(of)
        return F.when(F.col(of) > 0, known).otherwise(F.col("p"))

    def weight(of: str, kinds: str):
        return F.when(F.col(of) > 0, DISCOUNT * F.col(kinds) / F.col(of)).otherwise(F.lit(1.0))

    by_gram = (
        seen.join(contexts, F.shiftright("gram", BITS) == F.col("context"))
        .join(shared, low("gram", ORDER - 1) == F.col("key"))
        .select(F.col("gram").alias("key"), F.log(chance("toxic", "n1", "k1") / chance("ordinary", "n0", "k0")).alias("value"))
    )
    by_context = contexts.select(F.col("context").alias("key"), F.log(weight("n1", "k1") / weight("n0", "k0")).alias("value"))

    def table(df: DataFrame) -> Ratios:
        got = df.select("key", F.col("value").cast("float").alias("value")).toArrow()
        return Ratios.made(got.column("key").to_numpy(), got.column("value").to_numpy())

    return table(by_gram), table(by_context)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, into: tuple[str, str] = ("toxicity", "toxic_predicted")) -> DataFrame:
    """`docs` with two more columns: the score (double) and the prediction (int, 1 from `threshold` on), for every row.

    Null and empty texts get the score of a text without evidence. Ties don't arise; repeated rows get equal scores. The
    columns' names must be new to `docs`; an empty table gives an empty table.
    """
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in into}:
        raise ValueError(f"there are columns named {sorted(taken)}; give other names in `into`")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                x = shared.value.score(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(x), pa.array((x >= threshold).astype(np.int32))], [*some.schema.names, *into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType())])
    return docs.mapInArrow(each, schema)
