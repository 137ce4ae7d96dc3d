"""Exact removal of long repeated byte strings, by suffix arrays over what anchors leave undecided.

A string of LENGTH bytes that occurs twice has, in both places, the same anchor: the least-hashed substring of K bytes
in it. Consecutive starts of a text that have the same anchor form a span; two equal strings lie in spans with equal
anchors, at the same place relative to the anchor. So anchors deal out the work:

- A span whose whole content occurs again is all repeated. Copies of texts and long common passages end here.
- A span whose anchor occurs nowhere else repeats nothing.
- The rest, spans at the edges of common passages, meet by anchor. A suffix array of their contents, the anchor being
  one letter there, puts equal strings side by side, and each start is decided.
  Letters that only strings with a hash of their own cover stay out of it, since such strings equal no other.

Groups of more than GROUP different spans are cut by longer anchors, up to strings of the full length, where every
group is one string. Nothing is gathered without bound, and nothing is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.passages import powers, shared_windows
from quire.llm.shared import least, text_batches, written
from quire.llm.suffixes import suffix_array

LENGTH = 400
#: Lengths of anchors in turn; the last is LENGTH itself.
ANCHORS = (200, 300, 360, 400)
#: Different spans of one anchor that one suffix array takes.
GROUP = 1024
#: Letters of one suffix array, about; whole groups are put together.
LETTERS = 12_000
#: Bytes of one step of numpy work, about.
STEP = 1 << 18

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
LOW = np.uint64((1 << 32) - 1)
SPAN = "a bigint, s bigint, n1 bigint, n2 bigint, p int, w int, at int"
WORK = "a binary, n1 bigint, n2 bigint, p int, w int, at int, content binary, known boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _letters(data: np.ndarray) -> np.ndarray:
    return _mixed(data.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


BYTES = _letters(np.arange(256))


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on, by prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((BYTES[data] if data.dtype == np.uint8 else _letters(data)) * powers(BASE, n), out=sums[1:])
    return _mixed((sums[k:] - sums[: n - k + 1]) * powers(BACK, n - k + 1))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the first least value in each window, by doubling."""
    now, at, size = values, np.arange(len(values)), 1

    def less(x, i, y, j):
        later = y < x
        return np.where(later, y, x), np.where(later, j, i)

    while 2 * size <= width:
        n = len(now) - size
        now, at, size = *less(now[:n], at[:n], now[size:], at[size:]), 2 * size
    n, by = len(values) - width + 1, width - size
    return less(now[:n], at[:n], now[by : by + n], at[by : by + n])[1]


def least_at(hashes: np.ndarray, width: int) -> np.ndarray:
    """As first_least, by the upper halves of hashes, which their positions follow: minima within blocks from both sides."""
    n = len(hashes)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0))
    blocks[:n] = hashes & ~LOW | np.arange(n, dtype=np.uint64)
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : n]
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    return (np.minimum(before, after) & LOW).astype(np.int64)


def spans(texts: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """(owner, start, width, anchor's offset from start, anchor's hash) of every span of the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    sizes = np.array([len(x) for x in texts])
    begins = np.cumsum(sizes) - sizes
    hashes = substring_hashes(data, k)
    anchors = least_at(hashes, LENGTH - k + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchors)]
    inside = np.arange(len(anchors)) + LENGTH <= (begins + sizes)[owner]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    width = np.diff(np.append(first, len(anchors)))
    keep = inside[first]
    first, width = first[keep], width[keep]
    return owner[first], first - begins[owner[first]], width, anchors[first] - first, hashes[anchors[first]].view(np.int64)


def in_steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, x in enumerate(texts):
        if n and n + len(x) > STEP:
            yield start, i
            start, n = i, 0
        n += len(x)
    if n:
        yield start, len(texts)


def node(text: bytes) -> tuple[int, int]:
    low = xxhash.xxh3_128_intdigest(text)
    return tuple((x - (1 << 64)) if x >> 63 else x for x in (low >> 64, low & (1 << 64) - 1))


def first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every span, and one row for each row of `docs` with p = -1, w = bytes and the text's SHA-256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "s", "n1", "n2", "p", "w", "at", "doc_id", "sha"]
        types = [pa.int64()] * 4 + [pa.int32()] * 3
        for batch in it:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
            nodes = np.array([node(x) for x in texts], np.int64).reshape(-1, 2)
            n = len(texts)
            own = [None, None, nodes[:, 0], nodes[:, 1], np.full(n, -1), np.array([len(x) for x in texts]), None]
            columns = [pa.nulls(n, t) if c is None else pa.array(c).cast(t) for c, t in zip(own, types)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], names)
            for i, j in in_steps(texts):
                owner, start, width, at, a = spans(texts[i:j], ANCHORS[0])
                digest = xxhash.xxh3_64_intdigest
                some = texts[i:j]
                s = np.fromiter((digest(some[o][p:e]) for o, p, e in zip(owner.tolist(), start.tolist(), (start + width + LENGTH - 1).tolist())), np.uint64, len(owner))
                got = [a, s.view(np.int64), nodes[i + owner, 0], nodes[i + owner, 1], start, width, at]
                columns = [pa.array(c).cast(t) for c, t in zip(got, types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(owner), batch.column(0).type), pa.nulls(len(owner), pa.string())], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"{SPAN}, doc_id {kind}, sha string")


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(n1, n2, z): texts of LENGTH bytes and more, compressed to travel."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in it:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(0)]
            texts = [x for x in texts if len(x) >= LENGTH]
            nodes = np.array([node(x) for x in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.array([pack.compress(x) for x in texts], pa.binary())], ["n1", "n2", "z"])

    return docs.select(text_col).mapInArrow(each, "n1 bigint, n2 bigint, z binary")


def work_rows(touched: DataFrame) -> DataFrame:
    """The undecided spans of texts, with their contents."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64).to_pylist()
                rows = []
                for r in some:
                    wanted = [x for x in r["items"] if x["a"] is not None]
                    if wanted:
                        text = unpack.decompress(r["z"])
                        rows += [(x["a"].to_bytes(8, "little", signed=True), r["n1"], r["n2"], x["p"], x["w"], x["at"], text[x["p"] : x["p"] + x["w"] + LENGTH - 1], x["known"]) for x in wanted]
                yield made(rows)

    return touched.mapInArrow(each, WORK)


def made(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "n1", "n2", "p", "w", "at", "content", "known"])


def repeated_starts(members: list[tuple[int, int, int, bytes]], k: int) -> list[np.ndarray]:
    """For each (group, width, anchor's offset, content), which of its first `width` starts repeat within the group."""
    letters, begins, n = [], [], 0
    for i, (group, _, at, content) in enumerate(members):
        x = np.frombuffer(content, np.uint8).astype(np.int64)
        text = np.concatenate([x[:at], [1 << 20 | group], x[at + k :], [1 << 40 | i]])  # the last one ends the member
        letters.append(text)
        begins.append(n)
        n += len(text)
    text = np.concatenate(letters)
    size = LENGTH - k + 1
    found = np.zeros(len(text), bool)
    if len(text) < size:
        return [found[:0]] * len(members)
    # equal strings hash alike: the array need not hold letters that only strings with a hash of their own cover
    hashes = substring_hashes(text, size)
    order = np.argsort(hashes)
    pairs = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    open_ = np.zeros(len(text) + 1, bool)
    open_[order[pairs]] = open_[order[pairs + 1]] = True
    starts = np.flatnonzero(open_)
    if len(starts):
        edge = np.zeros(len(text) + 1, np.int64)
        edge[starts] = 1
        edge[starts + size] -= 1
        held = np.cumsum(edge) > 0
        ends = np.flatnonzero(held[:-1] > held[1:]) + 1
        held[ends] = True
        part = np.append(text, 0)
        part[ends] = (1 << 40) + np.arange(len(ends))  # each ends a run of letters
        order = np.flatnonzero(held)[suffix_array(part[held])]
        # neighbours whose first letters hash alike, and then are alike
        order = order[open_[order]]
        pairs = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        raw, step = text.tobytes(), text.itemsize
        at = (order * step).tolist()
        pairs = [i for i in pairs.tolist() if raw[at[i] : at[i] + size * step] == raw[at[i + 1] : at[i + 1] + size * step]]
        pairs = np.array(pairs, np.int64)
        found[order[pairs]] = found[order[pairs + 1]] = True
    return [found[b : b + width] for b, (_, width, _, _) in zip(begins, members)]


def decided(work: DataFrame, k: int) -> DataFrame:
    """(n1, n2, p, w): runs of repeated starts in the undecided spans, by suffix arrays over whole groups."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for i in range(0, batch.num_rows, 256):
                    yield from batch.slice(i, 256).to_pylist()

        def flush(held):
            groups: dict[bytes, int] = {}
            members = [(groups.setdefault(r["a"], len(groups)), r["w"], r["at"], r["content"]) for r in held]
            out = []
            for r, found in zip(held, repeated_starts(members, k)):
                if not r["known"]:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
                    out += [(r["n1"], r["n2"], r["p"] + int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2])]
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["n1", "n2", "p", "w"])

        held, n = [], 0
        for r in rows():
            if n > LETTERS and held[-1]["a"] != r["a"]:
                yield flush(held)
                held, n = [], 0
            held.append(r)
            n += len(r["content"]) - k + 2
        if held:
            yield flush(held)

    return work.repartition("a").sortWithinPartitions("a").mapInArrow(each, "n1 bigint, n2 bigint, p int, w int")


def cut_again(work: DataFrame, k: int) -> DataFrame:
    """Undecided spans cut by longer anchors, whose group is named by the anchor itself."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256).to_pylist()
                owner, start, width, at, _ = spans([r["content"] for r in some], k)
                rows = []
                for o, p, w, x in zip(owner.tolist(), start.tolist(), width.tolist(), at.tolist()):
                    r, content = some[o], some[o]["content"][p : p + w + LENGTH - 1]
                    rows.append((xxhash.xxh3_128_digest(content[x : x + k]), r["n1"], r["n2"], r["p"] + p, w, x, content, r["known"]))
                yield made(rows)

    return work.mapInArrow(each, WORK)


def resolve(work: DataFrame, level: int = 0) -> DataFrame:
    """(n1, n2, p, w): runs of repeated starts in `work`, whose spans have different contents within a group."""
    k = ANCHORS[level]
    sizes = work.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > GROUP), "large")
    if not large.take(1):
        return decided(work, k)
    out = decided(work.join(large, "a", "left_anti"), k)
    cut = written(cut_again(work.join(large.select("a"), "a", "left_semi"), ANCHORS[level + 1]), "cut")
    if not cut.take(1):
        return out
    alike = cut.groupBy("a", "content").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("some"), F.min(F.struct("n1", "n2", "p", "w", "at")).alias("one"))
    alike = written(alike.withColumn("whole", F.expr("n > 1 or some")), "alike")
    same = cut.where("not known").join(alike.where("n > 1").select("a", "content"), ["a", "content"], "left_semi")
    out = out.unionByName(same.select("n1", "n2", "p", "w"))
    if level + 2 == len(ANCHORS):
        return out
    open_ = alike.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(~F.col("whole")).alias("single")).where("kinds > 1 and single > 0")
    left = alike.join(open_.select("a"), "a", "left_semi").select("a", "one.n1", "one.n2", "one.p", "one.w", "one.at", "content", F.col("whole").alias("known"))
    return out.unionByName(resolve(written(left, "work"), level + 1))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, n_shared, n_common) for every row of `docs`.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in the same or another row;
    `removed` lists the maximal runs as (start, end) in bytes. n_shared tells of shorter common passages, which stay:
    it counts the text's anchors, strings of ANCHORS[0] bytes, that other texts hold too, and its further copies.
    n_common counts exactly the windows of 51 words that another row holds too (see passages.py), of any length. Null
    texts are empty, texts of fewer than LENGTH bytes keep everything and share nothing; rows that repeat are copies of
    each other. Other columns are ignored; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    first = written(first_pass(docs, id_col, text_col), "spans")
    found = first.where("p >= 0").select("a", "s", "n1", "n2", "p", "w", "at")
    alike = found.groupBy("a", "s").agg(
        F.count(F.lit(1)).alias("n"), least("n1", "n2", "p", "w", "at").alias("one"), F.max("n1").alias("most")
    )
    # a span that several texts hold tells so itself; one that a single text holds shares its anchor with other spans
    same = Window.partitionBy("a")
    alike = alike.select(
        "*", F.count(F.lit(1)).over(same).alias("kinds"), (F.count_if(F.col("n") == 1).over(same) > 0).alias("item"), (F.min("one.n1").over(same) < F.max("most").over(same)).alias("shared")
    )
    # spans whose anchor occurs nowhere else end here
    alike = written(alike.where("n > 1 or kinds > 1 and (item or shared)"), "alike")
    undecided = alike.where("kinds > 1 and (item or shared) and (item or one.n1 = most)")
    undecided = undecided.select("one.n1", "one.n2", "one.p", "one.w", "one.at", "a", (F.col("n") > 1).alias("known"), "item", F.expr("shared and one.n1 = most").alias("shared"))
    met = found.join(alike.where("n > 1").select("a", "s", (F.col("one.n1") < F.col("most")).alias("shared")), ["a", "s"])
    met = met.select("n1", "n2", "p", "w", "at", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("boolean").alias("known"), F.lit(True).alias("item"), "shared").distinct()
    item = F.when(F.col("item"), F.struct("p", "w", "at", "a", "known"))
    items = undecided.unionByName(met).groupBy("n1", "n2").agg(F.collect_list(item).alias("items"), F.count_if("shared").alias("n_shared"))
    # copies of a text are one row before they meet their items
    texts = packed(docs, text_col).groupBy("n1", "n2").agg(F.first("z").alias("z"))
    touched = written(texts.join(items, ["n1", "n2"]), "touched")
    runs = resolve(written(work_rows(touched), "work")).groupBy("n1", "n2").agg(F.collect_list(F.struct("p", "w")).alias("runs"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(i, 64).to_pylist():
                    text = unpack.decompress(r["z"])
                    starts = [(x["p"], x["w"]) for x in r["items"] if x["a"] is None] + [(x["p"], x["w"]) for x in r["runs"] or ()]
                    edge = np.zeros(len(text) + 1, np.int64)
                    if starts:
                        p, w = np.array(starts).T
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + w + LENGTH - 1, -1)
                    gone = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
                    at = np.flatnonzero(np.diff(gone)).tolist()
                    kept, last = hashlib.sha256(), 0
                    for a, b in zip(at[::2], at[1::2]):
                        kept.update(text[last:a])
                        last = b
                    kept.update(text[last:])
                    rows.append((r["n1"], r["n2"], r["n_shared"], int(gone.sum()), kept.hexdigest(), [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2])]))
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["n1", "n2", "n_shared", "n_removed", "kept", "removed"])

    ended = touched.join(runs, ["n1", "n2"], "left").mapInArrow(cut, "n1 bigint, n2 bigint, n_shared bigint, n_removed bigint, kept string, removed array<struct<start:bigint,end:bigint>>")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = first.where("p < 0").select("doc_id", "n1", "n2", F.col("w").cast("bigint").alias("n_bytes"), "sha")
    copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("n1", "n2").agg((F.count(F.lit(1)) - 1).alias("copies"))
    # the counts are written, so that a text with very many copies can be split over tasks
    ended = written(copies.join(ended, ["n1", "n2"], "left"), "ended")
    zero = F.lit(0).cast("bigint")
    common = written(shared_windows(docs, text_col), "common")
    return rows.join(ended, ["n1", "n2"], "left").join(common, "n1", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce(F.size("removed"), zero).cast("bigint").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("removed", none).alias("removed"), (F.coalesce("n_shared", zero) + F.coalesce("copies", zero)).alias("n_shared"),
        F.coalesce("n_common", zero).alias("n_common"),
    )
