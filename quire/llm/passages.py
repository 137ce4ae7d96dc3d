"""Runs of words that several texts hold, counted exactly by windows of WORDS words.

Two equal windows have the same anchor: the least-hashed run of K words in it. Consecutive windows of a text that have
the same anchor form a span. Anchors that a single text holds settle most spans; a bitmap of the others lets only spans
that may be shared leave the texts. A span that another text holds as a whole is shared; the rest, at the edges of
common passages, is compared window by window. Words are separated by ASCII white space, which is not compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import least, written

WORDS = 51
#: Words of an anchor.
K = 8
#: Bits of the bitmap at most (16 MB); there are 16 for each anchor up to there.
MAP_BITS = 1 << 27

#: Powers of a base that are kept (4 MB).
POWERS = 1 << 19

BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def _first_powers(base: int) -> np.ndarray:
    return _powers(base, POWERS)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of `base`, from a table unless there are very many."""
    return _first_powers(base)[:n] if n <= POWERS else _powers(base, n)


class Ranges:
    """Hashes of ranges of a sequence of hashes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, n), dtype=np.uint64)])
        self.back = powers(pow(BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def word_spans(texts: list[bytes]) -> tuple:
    """(owner, first window, windows, anchor's hash) of every span, the ranges of all words, and the place of each
    text's first word."""
    from quire.llm.repeats import least_at

    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    sizes = np.array([len(x) + 1 for x in texts])
    begins = np.searchsorted(start, np.cumsum(sizes) - sizes)
    none = np.zeros(0, np.int64)
    if len(start) < WORDS:
        return none, none, none, none, None, begins
    words = Ranges(Ranges(LETTERS[data]).of(start, end))
    at = np.arange(len(start) - K + 1)
    grams = words.of(at, at + K)
    anchors = least_at(grams, WORDS - K + 1)
    at = np.arange(len(anchors))
    ends = np.append(begins[1:], len(start))
    owner = np.repeat(np.arange(len(texts)), ends - begins)[: len(at)]
    inside = at + WORDS <= ends[owner]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    width = np.diff(np.append(first, len(anchors)))
    keep = inside[first]
    first, width = first[keep], width[keep]
    return owner[first], first, width, grams[anchors[first]].view(np.int64), words, begins


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes `h`, in words of 64 bits; at most MAP_BITS / 64 words come to the driver."""
    n = hashes.select(F.approx_count_distinct("h")).first()[0]
    bits = min(MAP_BITS, 1 << max(10, (16 * n).bit_length()))
    bit = hashes.select(F.expr(f"h & {bits - 1}L").alias("bit"))
    found = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return out


def shared_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n1, n_common): for each text, named by the first half of `node`, its windows that another row holds too.

    Texts without such windows are left out; a text that several rows have shares all its windows.
    """
    from quire.llm.repeats import in_steps, node

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple]:
        texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(0)]
        nodes = np.array([node(x)[0] for x in texts], np.int64)
        for i, j in in_steps(texts):
            yield nodes[i:j], word_spans(texts[i:j])

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for nodes, (owner, _, _, h, *_) in found_in(batch):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(nodes[owner])], ["h", "n1"])

    text = docs.select(text_col)
    several = F.min("n1") < F.max("n1")
    held = text.mapInArrow(anchors, "h bigint, n1 bigint").groupBy("h").agg(several.alias("several")).where("several").select("h")
    filled = docs.sparkSession.sparkContext.broadcast(bitmap(written(held, "anchors")))

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans whose anchors several texts may hold, with their windows; and a row for each text with p = -1."""
        bits = filled.value
        names = ["n1", "p", "w", "h", "s", "v"]
        for batch in it:
            for nodes, (owner, first, width, h, words, begins) in found_in(batch):
                if not len(owner):
                    continue
                n_windows = np.bincount(owner, width, len(nodes)).astype(np.int32)
                own = np.flatnonzero(n_windows)
                n, none = len(own), pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(np.full(n, -1, np.int32)), pa.array(n_windows[own]), none, none, pa.nulls(n, pa.list_(pa.int64()))], names)
                low = h & ((len(bits) << 6) - 1)
                at = np.flatnonzero((bits[low >> 6] >> (low & 63)) & 1)
                owner, first, width, h = owner[at], first[at], width[at], h[at]
                s = words.of(first, first + width + WORDS - 1).view(np.int64)
                ends = np.cumsum(width)
                v = np.repeat(first - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
                v = words.of(v, v + WORDS).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[owner]), pa.array((first - begins[owner]).astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(h), pa.array(s), lists], names)

    rows = written(text.mapInArrow(candidates, "n1 bigint, p int, w int, h bigint, s bigint, v array<bigint>"), "candidates")
    # copies share everything; from here on a text is there once
    copies = rows.where("p < 0").groupBy("n1").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).where("n > 1").select("n1", F.col("w").cast("bigint").alias("n"))
    spans = written(rows.where("p >= 0").select("n1", "p", "w", "h", "s").distinct(), "spans")
    kinds = written(spans.groupBy("h", "s").agg(several.alias("whole"), least("n1", "p").alias("one"), F.min("n1").alias("least"), F.max("n1").alias("most")), "kinds")
    whole = spans.join(kinds.where("whole").select("h", "s"), ["h", "s"]).select("n1", F.col("w").cast("bigint").alias("n"))
    # the windows of other spans, and those of one span of each kind that is shared as a whole
    open_ = kinds.groupBy("h").agg(F.count_if(~F.col("whole")).alias("single"), (F.min("least") < F.max("most")).alias("several")).where("single > 0 and several").select("h")
    open_ = kinds.join(open_, "h").select("h", "s", "whole", "one")
    wanted = spans.join(open_, ["h", "s"]).where("not whole or n1 = one.n1 and p = one.p").select("n1", "p", "whole")
    lists = rows.where("p >= 0").join(wanted, ["n1", "p"]).groupBy("n1", "p").agg(F.first("whole").alias("whole"), F.first("v").alias("v"))
    windows = written(lists.select("n1", "p", "whole", F.posexplode("v").alias("i", "v")), "windows")
    met = windows.groupBy("v").agg((several | F.max("whole")).alias("met")).where("met").select("v")
    edge = windows.where("not whole").join(met, "v").select("n1", F.lit(1).cast("bigint").alias("n"))
    partly = whole.unionByName(edge).groupBy("n1").agg(F.sum("n").alias("n"))
    return partly.unionByName(copies).groupBy("n1").agg(F.max("n").alias("n_common"))
