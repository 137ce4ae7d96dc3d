"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case; numbers, units after numbers, and runs of capitalised words inside a
sentence (names) become typed placeholders. Every window of WINDOW template words is hashed and joined with the
benchmark's windows. Windows of one item that match a text at one offset are taken together, and their slots must map
one to one: the same benchmark value always to the same text value and back. So a question asked again with other
numbers or names is caught, and a chance meeting of placeholders is not.

Two more lookups stand beside it. One takes every capitalised word as part of a name, wherever it stands, so that what
comes before an item doesn't matter and names may begin sentences. The other takes the plain words, without
placeholders, of every item and window, so that verbatim copies are found however few literal words they have.
Characters of scripts without spaces are words of their own.

Both sides of the join are tables. The texts pass by once: a bitmap of the benchmark's window hashes, of MAP_BITS at
most, is broadcast, and only windows that may match leave the texts, with the values in their slots. The bitmap prunes
and decides nothing; what it lets through by chance fails in the join, whose frequent windows Spark splits over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import free_name, text_batches, text_hashes, written

WINDOW = 8
#: Literal words that a window needs, as a share of it; windows of placeholders say nothing.
LITERAL = 0.5
#: Windows of an item that must match a text, or all if it has fewer.
MATCHES = 3
#: Bits of the bitmap at most (16 MB); there are 64 for each window up to there.
MAP_BITS = 1 << 27
#: Different words that a worker remembers.
KNOWN = 500_000
#: The lookups: names inside sentences, names anywhere, no placeholders.
TYPED, WIDE, PLAIN = LOOKUPS = (0, 1, 2)

# Fixed values
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"
SENTENCE_ENDS = ".!?:"
UNITS = {"kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "yd", "l", "ml", "s", "sec", "ms", "min", "h", "hr", "hrs", "kwh", "kw", "w", "v", "hz", "mph", "kmh", "usd", "eur", "percent", "dollars", "euros", "cents", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "meters", "metres", "kilometers", "grams", "kilograms", "liters", "litres", "pounds", "inches", "feet"}

NUMBER, UNIT, NAME, NOTHING = 1, 2, 3, 0
_number = re.compile(r"[+-]?\d[\d.,:/]*")
_glued = re.compile(r"\d[\d.,]*([^\W\d_]+)")
# Thai to Myanmar, Khmer, kana, Han
_unspaced = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
# The low bits of a word's number say what it is; the rest is its hash.
CAPITAL, ENDS, IS_UNIT, IS_NUMBER = 1, 2, 4, 8
FLAGS = np.uint64(15)


def word_number(word: str) -> int:
    if word.isalpha() and word.islower() and word not in UNITS:  # most words
        return xxhash.xxh64_intdigest(word.encode(), 7) & ~15 | 1 << 63
    core = word.strip(PUNCTUATION)
    ends = ENDS if word.rstrip("\"'”’)»")[-1:] in SENTENCE_ENDS and word.rstrip("\"'”’)»") else 0
    if not core:
        return ends  # hash zero: no word
    low = core.lower()
    hashed = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7) & ~15 | 1 << 63
    if (core[0].isdigit() or core[0] in "+-") and (_number.fullmatch(core) or ((m := _glued.fullmatch(core)) and m[1].lower() in UNITS)):
        return hashed | ends | IS_NUMBER
    return hashed | ends | (CAPITAL if core[0].isupper() else 0) | (IS_UNIT if low in UNITS else 0)


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return (text if text.isascii() else _unspaced.sub(r" \1 ", text)).split()


class Words(dict):
    """Word numbers, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = found = word_number(word)
        return found


@dataclass
class Template:
    """Template words of texts end to end, in one of the lookups."""

    hashes: np.ndarray
    kinds: np.ndarray  # 0 for literal words
    values: np.ndarray  # what stands there, a number for each different run of words
    places: np.ndarray  # the first word's place in its text's split
    starts: np.ndarray  # one for each text, and the end


def templates(split: list[list[str]], words: Words) -> list[Template]:
    """The texts' template in each lookup."""
    sizes = [len(x) for x in split]
    raw = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, sum(sizes))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    places = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    flags = (raw & FLAGS).astype(np.uint8)
    first = places == 0
    after_end = np.ones(len(raw), bool)
    after_end[1:] = (flags[:-1] & ENDS) > 0
    after_number = np.zeros(len(raw), bool)
    after_number[1:] = (flags[:-1] & IS_NUMBER) > 0
    after_number[first] = False
    plain = raw & ~FLAGS
    capital = (flags & CAPITAL) > 0
    is_word = np.flatnonzero(plain)
    owner = np.repeat(np.arange(len(split)), sizes)[is_word]
    same_text = np.zeros(len(owner), bool)
    same_text[1:] = owner[1:] == owner[:-1]
    out = []
    for lookup in LOOKUPS:
        value, place, own = plain[is_word], places[is_word], owner
        kind = np.zeros(len(value), np.uint8)
        if lookup != PLAIN:
            kinds = np.zeros(len(raw), np.uint8)
            kinds[capital if lookup == WIDE else capital & ~after_end & ~first] = NAME
            kinds[((flags & IS_UNIT) > 0) & after_number] = UNIT
            kinds[(flags & IS_NUMBER) > 0] = NUMBER
            kind = kinds[is_word]
            # a run of words of a name is one template word
            name = kind == NAME
            more = np.flatnonzero(name[1:] & name[:-1] & same_text[1:]) + 1
            if len(more):
                run = np.concatenate([[True], np.diff(more) > 1])
                inside = np.arange(len(more)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(more)))) + 1
                np.add.at(value, more - inside, value[more] * (2 * inside.astype(np.uint64) + np.uint64(1)))
                keep = np.ones(len(value), bool)
                keep[more] = False
                value, place, own, kind = value[keep], place[keep], own[keep], kind[keep]
        hashes = value.copy()
        hashes[kind > 0] = kind[kind > 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out.append(Template(hashes, kind, value.view(np.int64), place, np.searchsorted(own, np.arange(len(split) + 1))))
    return out


def windows(hashes: np.ndarray, n: int, lookup: int = TYPED) -> np.ndarray:
    """The hash of the n words from each position on; those of other lookups or lengths differ."""
    if len(hashes) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(hashes) - n + 1, 16 * lookup + n, np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + hashes[k : len(hashes) - n + 1 + k]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(29)).view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of (item, item_id, text): hash, item, lookup, its words, start, kinds, values, the item's windows in all."""
    kind = items.schema["item_id"].dataType.simpleString()
    names = ["item", "item_id", "lookup", "n", "total", "start", "hash", "kinds", "theirs"]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in it:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for lookup, t in enumerate(templates([words_of(text)], words)):
                    n = min(WINDOW, len(t.hashes))
                    if not n:
                        continue
                    wanted = np.ones(len(t.hashes) - n + 1, bool)
                    if lookup != PLAIN:
                        wanted = (np.convolve(t.kinds == 0, np.ones(n), "valid") >= LITERAL * n) & (n >= 3)
                    hashes = windows(t.hashes, n, lookup)
                    total = int(wanted.sum())
                    rows += [(i, lookup, n, total, s, int(hashes[s]), t.kinds[s : s + n].tolist(), t.values[s : s + n].tolist()) for s in np.flatnonzero(wanted).tolist()]
                    if len(rows) > 20_000:
                        yield made(batch, rows)
                        rows = []
            if rows:
                yield made(batch, rows)

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        own, *columns = zip(*rows)
        types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        at = pa.array(own, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    schema = f"item bigint, item_id {kind}, lookup int, n int, total int, start int, hash bigint, kinds array<int>, theirs array<bigint>"
    return items.mapInArrow(each, schema)


def bitmap(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """(words, bits) of a bitmap with two bits for each window hash; at most MAP_BITS / 64 words come to the driver."""
    n = wanted.select(F.approx_count_distinct("hash")).first()[0]
    bits = min(MAP_BITS, 1 << max(10, (64 * n).bit_length()))
    both = wanted.select(F.explode(F.array(F.expr(f"hash & {bits - 1}L"), F.expr(f"shiftrightunsigned(hash, 32) & {bits - 1}L"))).alias("bit"))
    found = both.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return out, bits


def text_windows(docs: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    """(h1, h2, hash, at, place, mine): windows of texts that may be among the wanted ones; h1 and h2 name the text."""
    lookups = [tuple(r) for r in wanted.select("lookup", "n").distinct().collect()]  # 24 at most
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        filled, bits = shared.value
        seen = lambda x: (filled[x >> 6] >> (x & 63)) & 1
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                found = templates([words_of(x) for x in some.column(2).to_pylist()], words)
                for lookup, n in lookups:
                    t = found[lookup]
                    hashes = windows(t.hashes, n, lookup)
                    near = np.flatnonzero(seen(hashes & (bits - 1)))
                    near = near[seen((hashes[near] >> 32) & (bits - 1)) > 0]
                    own = np.searchsorted(t.starts, near, "right") - 1
                    whole = near + n <= t.starts[own + 1]
                    near, own = near[whole], own[whole]
                    if not len(near):
                        continue
                    values = pa.array(t.values[near[:, None] + np.arange(n)].ravel())
                    mine = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(near) + 1, n), pa.int32()), values)
                    at = pa.array(own)
                    numbers = [pa.array(hashes[near]), pa.array((near - t.starts[own]).astype(np.int32)), pa.array(t.places[near].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), *numbers, mine], ["h1", "h2", "hash", "at", "place", "mine"])

    rows = docs.select(*text_hashes(text), text.alias("text")).where("text is not null")
    return rows.mapInArrow(each, "h1 bigint, h2 bigint, hash bigint, at int, place int, mine array<bigint>")


def found_items(docs: DataFrame, benchmark: DataFrame, text: Column, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(h1, h2, item, item_id, n_windows, item_windows, first_word, n_slots, other_values): one row per text and item in it."""
    text_batches(docs.sparkSession)
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    wanted = written(item_windows(items), "windows")
    near = written(text_windows(docs, text, wanted), "near")
    # a row for each slot's place in the item, its value there and its value here
    slots = F.expr("filter(transform(theirs, (x, i) -> struct(if(kinds[i] > 0, start + i, -1) as p, x as theirs, mine[i] as mine)), x -> x.p >= 0)")
    met = near.join(wanted, "hash").where("size(mine) = n").withColumn("slots", slots)
    met = met.groupBy("h1", "h2", "item", "lookup", (F.col("at") - F.col("start")).alias("shift"), "start").agg(F.first("total").alias("total"), F.first("item_id").alias("item_id"), F.min("place").alias("place"), F.first("slots").alias("slots"))
    offsets = met.groupBy("h1", "h2", "item", "lookup", "shift").agg(
        F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.first("item_id").alias("item_id"),
        F.min(F.struct("start", "place")).alias("first"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    pairs = "array_distinct(transform(slots, x -> struct(x.theirs, x.mine)))"
    side = "size(array_distinct(transform({p}, x -> x.{c}))) = size({p})"
    fits = offsets.where(f"n >= least({MATCHES}, total)").withColumn("pairs", F.expr(pairs)).where(f"{side.format(p='pairs', c='theirs')} and {side.format(p='pairs', c='mine')}")
    rank = F.struct(-F.col("lookup"), "n", -F.col("first.place"), F.size("slots").alias("slots"))
    other = F.expr("exists(pairs, x -> x.theirs <> x.mine)")
    row = F.struct("item_id", F.col("n").cast("int").alias("n_windows"), F.col("total").alias("item_windows"), F.col("first.place").cast("bigint").alias("first_word"), F.size("slots").alias("n_slots"), other.alias("other_values"))
    return fits.groupBy("h1", "h2", "item").agg(F.max_by(row, rank).alias("best")).select("h1", "h2", "item", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, first_word, n_slots, other_values): one row per text and item in it.

    Null texts and items match nothing, nor do items without words; items of fewer than three template words match
    verbatim only. Ids may be of any type, null or repeated, on both sides. Windows are counted in the first lookup that
    finds the item (typed, wide, plain); where it is met at several offsets, the one with most windows counts, then the
    first. Rows that repeat are found as often; other columns are ignored; empty tables give no rows.
    """
    found = found_items(docs, benchmark, F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_hashes(F.col(text_col)))
    return rows.join(found, ["h1", "h2"]).drop("h1", "h2", "item")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose texts hold no benchmark item; see `leaks`.

    Rows with null or empty texts stay, repeated rows stay or go together, columns may have any names, ids don't
    matter; empty tables leave everything.
    """
    names = [free_name(docs, x) for x in ("h1", "h2")]
    found = written(found_items(docs, benchmark, F.col(text_col)).select("h1", "h2").distinct().toDF(*names), "leaks")
    marked = docs.withColumns(dict(zip(names, text_hashes(F.col(text_col)))))
    return marked.join(found, names, "left_anti").select(*docs.columns)
