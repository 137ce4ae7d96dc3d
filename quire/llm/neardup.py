"""One document of each group of near copies: SimHash with pigeonring chains, verified by shingle sets.

Near copies are texts whose sets of word shingles have a Jaccard similarity of 0.8 or more. Each set has a fingerprint
of 1,024 bits. The first 512, 64 segments of eight bits, lie on six rings (by steps of 1, 3, ... 11 segments). Of a pair
that differs in TAU of them or fewer, a chain of consecutive segments of some ring stays within proportional budgets: l
segments differ in l * TAU / 64 bits together at most. A chain is looked up by its first three segments, which have to
be equal; the differences of the first four to eight are held against their budgets, then those of all 1,024 bits
against WHOLE_TAU, and what remains is compared set by set. Sets of few shingles, whose fingerprints say little, are
also looked up by their least shingles, one of which they share if they are similar.

No bucket is turned into pairs. Its rows are sorted, a large bucket over several tasks, and the first pass compares each
text once: with the least of those that come first in its buckets, which joins most of a large group. Buckets of two
are compared then, too. The second pass takes the buckets that still hold several components, leaves the largest of them alone, and compares the others with it
and with each other, in units of bounded size; it misses no pair of different components that shares a bucket and stays
within the budgets, so that nothing is left for a third.

Equal sets are one node, so exact copies cost nothing. A pair at a similarity of 0.8 has 192 chains of about 2 % each:
0.9 of such pairs are found, and 0.98 at 0.84 (simulated; recall against brute force is tested).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import connected_components, free_name, text_batches, text_hashes, written

SEED = 42
#: Bits that may differ of the first 512, and of all 1,024: 77 and 153 are expected at a similarity of 0.8, give or take 8 and 11.
TAU, WHOLE_TAU = 92, 175
#: Rings, by their steps, and the chains on them, by the segments that they begin with.
STEPS = (1, 3, 5, 7, 9, 11)
CHAINS = np.array([[(t + s * k) % 64 for k in range(8)] for s in STEPS for t in range(0, 64, 2)])
#: Bits by which the first l segments of a chain may differ, l from one to eight.
BUDGETS = np.array([length * TAU // 64 for length in range(1, 9)])
#: Sets of up to so many shingles are also looked up by their least shingles; 32 or fewer miss nothing that way.
FEW, FEW_TAU = 40, 280
#: Keys from here on are shingles, those below are chains.
SHINGLES = 1 << 62
#: Rows of one unit of the second pass: of components but the largest, and of all.
UNIT = (2048, 8192)
#: Rows of numbers in a batch.
ROWS = 20_000

BITS = np.array([i.bit_count() for i in range(256)], np.uint8)
#: Odd multipliers that turn a shingle's hash into its 64 bits of each fingerprint.
MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(16)]


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The hashes of a text's shingles, sorted; words are lower-cased in A-Z, fewer than n words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = max(len(words) - n + 1, min(len(words), 1))
    digest, found = xxhash.xxh64_intdigest, [np.zeros(0, np.uint64)]
    for at in range(0, count, 1 << 16):
        some = words[at : at + (1 << 16) + n - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
        found.append(np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64)))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The 128 bytes of a set's fingerprint: a bit is set if it is in over half the shingles."""
    out = []
    for m in MULTIPLIERS:
        count = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            h = shingles[at : at + (1 << 16)]
            h = (h ^ (h >> np.uint64(32))) * m
            h = h ^ (h >> np.uint64(29))
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(shingles), bitorder="little"))
    return np.concatenate(out)


def least_shingles(shingles: np.ndarray) -> np.ndarray:
    """Of a set of few shingles those of which a similar set has one: what is left without four fifths, and one more."""
    n = len(shingles)
    return shingles[: n - -(-4 * n // 5) + 1] if 0 < n <= FEW else shingles[:0]


def print_bytes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 128)


def many_rows(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df`, which holds numbers, written with ROWS rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS))
    try:
        return written(df, name)
    finally:
        spark.conf.set(key, before)


def prints(docs: DataFrame, ident: Column, text: Column, n: int) -> DataFrame:
    """(id, h1, h2, key, size, print, least) for every row: hashes of the text, and what its set of shingles gives."""
    rows = docs.select(ident.alias("id"), *text_hashes(text), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [shingle_set(x.as_py(), n) for x in batch.column(3)]
            columns = [
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int32()),
                pa.array([print_of(x).tobytes() for x in sets], pa.binary()),
                pa.array([least_shingles(x).tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "h1", "h2", "key", "size", "print", "least"])

    return rows.mapInArrow(each, f"id {kind}, h1 bigint, h2 bigint, key binary, size int, print binary, least binary")


def lookups(nodes: DataFrame) -> DataFrame:
    """(key, node, chain): a row for each chain of a node, with its eight segments, and for each of its least shingles."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                yield made(batch.slice(i, 512))

    def made(some: pa.RecordBatch) -> pa.RecordBatch:
        node = some.column(0).to_numpy()
        own = print_bytes(some.column(1))[:, CHAINS]  # nodes x chains x 8
        key = np.arange(len(CHAINS)) << 24 | own[..., 0].astype(np.int64) << 16 | own[..., 1].astype(np.int64) << 8 | own[..., 2]
        least = [np.frombuffer(x, np.uint64) for x in some.column(2).to_pylist()]
        shingles = (np.concatenate(least) >> np.uint64(2)).astype(np.int64) + SHINGLES
        keys = np.concatenate([key.ravel(), shingles])
        nodes_ = np.concatenate([np.repeat(node, len(CHAINS)), np.repeat(node, [len(x) for x in least])])
        chains = np.concatenate([np.ascontiguousarray(own).view("<i8").ravel(), np.zeros(len(shingles), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes_), pa.array(chains)], ["key", "node", "chain"])

    return nodes.select("node", "print", "least").mapInArrow(each, "key bigint, node bigint, chain bigint")


def within_budgets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether chains, rows of eight segments, stay within the budgets from their beginning on."""
    return (np.cumsum(BITS[x ^ y], axis=1) <= BUDGETS).all(axis=1)


def first_of_buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, first, near, pair) of sorted (key, node, chain): the rows of buckets, whether each is near its first,
    and whether these two are the whole bucket.

    Rows stream through; a bucket that goes on in another task has a first in each, and its rows come out even if they
    are alone.
    """

    def made(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "node", "first", "near", "pair"])

    held = None  # the open bucket's key, first node and its chain; whether the first has come out
    begun = False
    for batch in it:
        if not batch.num_rows:
            continue
        key, node, chain = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), bool)  # False for the row that stands for the open bucket
        if held:
            key, node, chain = (np.concatenate([np.array([x], np.int64), y]) for x, y in zip(held[:3], (key, node, chain)))
            new = np.concatenate([[not held[3]], new])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        at = np.repeat(starts, sizes)
        out = new & (np.repeat(sizes, sizes) > 1)
        whole = sizes == 2
        whole[[0, -1]] = False  # these may go on in another batch or task
        if not begun:
            out[: sizes[0]] = True  # the bucket may have begun in the task before
        begun = True
        near = at != np.arange(len(key))
        chains = np.flatnonzero(near & out & (key < SHINGLES))
        near[chains] = within_budgets(*(np.ascontiguousarray(chain[x]).view(np.uint8).reshape(-1, 8) for x in (chains, at[chains])))
        yield made(key[out], node[out], node[at[out]], near[out], (near & np.repeat(whole, sizes))[out])
        last = starts[-1]
        held = (key[last], node[last], chain[last], bool(out[last]) or not new[last])
    if held and not held[3]:
        yield made(*(np.array([x], np.int64) for x in (held[0], held[1], held[1])), np.array([False]), np.array([False]))


def compared(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of different components within the budgets, of rows (key, x, y, role, node, component, print) of units."""

    def pairs(unit: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = np.flatnonzero(unit["role"] == 0)
        offers = np.flatnonzero(unit["role"] == 1)
        shingle = unit["key"][0] >= SHINGLES
        number = int(unit["key"][0]) >> 24
        bits, component, node = unit["print"], unit["component"], unit["node"]
        for i in asks:
            some = offers[component[offers] != component[i]]
            # a pair of two that ask comes once
            some = some[(node[some] > node[i]) | ~unit["minor"][some]]
            differ = BITS[bits[some] ^ bits[i]]
            near = np.flatnonzero(differ.sum(1, dtype=np.int64) <= (FEW_TAU if shingle else WHOLE_TAU))
            if not shingle:  # and once of all chains that it has in common
                steps = np.cumsum(differ[near][:, CHAINS], axis=2)
                met = (steps[..., 2] == 0) & (steps <= BUDGETS).all(axis=2)
                near = near[met.any(1) & (met.argmax(1) == number)]
            if len(near):
                yield np.full(len(near), node[i]), node[some[near]]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(unit: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(unit)
            columns = {c: table.column(c).to_numpy() for c in ("key", "role", "node", "component", "minor")}
            found = list(pairs(columns | {"print": print_bytes(table.column("print"))}))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        held, name = [], None
        for batch in it:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if held and (names[:, i] != name).any():
                    yield made(held)
                    held = []
                held.append(batch.slice(i, j - i))
                name = names[:, i]
        if held:
            yield made(held)

    units = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "role", "node", "component", "minor", "print")
    return units.mapInArrow(each, "a bigint, b bigint")


def left_to_compare(buckets: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The second pass: pairs of different components that share a bucket and stay within the budgets."""
    members = buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members, "members")
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.max("first").alias("most"), F.max("near").alias("near"), F.max("pair").alias("pair"))
    keys = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("top"), (F.min("least") < F.max("most")).alias("apart"), F.max("near").alias("near"), F.max("pair").alias("pair")
    )
    # two rows that are not near each other need no comparison, or have been compared
    keys = keys.where("components > 1 and not pair and (rows > 2 or apart or near)").select(
        "key", F.col("top.component").alias("top"),
        F.expr(f"cast(ceil((rows - top.n) / {UNIT[0]}) as int)").alias("xs"), F.expr(f"cast(ceil(rows / {UNIT[1]}) as int)").alias("ys"),
    )
    keys = written(keys, "keys")
    prints_of = nodes.select(F.col("node").alias("of"), "print")
    rows = members.join(keys, "key").withColumn("minor", F.col("component") != F.col("top"))
    rows = written(rows.join(prints_of, F.col("node") == F.col("of")), "contested")
    own = "cast(pmod(xxhash64('{0}', node), {0}s) as int)"
    offers = rows.select("*", F.lit(1).alias("role"), F.expr("explode(sequence(0, xs - 1))").alias("x"), F.expr(own.format("y")).alias("y"))
    asks = rows.where("minor").select("*", F.lit(0).alias("role"), F.expr("explode(sequence(0, ys - 1))").alias("y"), F.expr(own.format("x")).alias("x"))
    columns = ["key", "x", "y", "role", "node", "component", "minor", "print"]
    return compared(offers.select(columns).unionByName(asks.select(columns)))


def near_copies(docs: DataFrame, rows: DataFrame, nodes: DataFrame, ident: Column, text: Column, n: int, similarity: float) -> DataFrame:
    """(node, component) of all nodes that are linked with another."""
    spark = docs.sparkSession

    def shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [shingle_set(x.as_py(), n).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "shingles"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                some, all_ = sorted((p, q), key=len)
                at = np.searchsorted(all_, some)
                at[at == len(all_)] = 0
                both = int((all_[at] == some).sum()) if len(all_) else 0
                alike.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "candidates")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = nodes.join(wanted, "node").select("node", F.col("one.id").alias("id"), "one.h1", "one.h2")
        # a shuffle at every size: the wanted texts grow with all texts
        texts = docs.select(ident.alias("id"), *text_hashes(text), F.coalesce(text, F.lit("")).alias("text")).alias("t")
        met = texts.join(wanted.hint("merge").alias("w"), F.expr("t.h1 = w.h1 and t.h2 = w.h2 and t.id <=> w.id"))
        sets = met.groupBy("w.node").agg(F.first("t.text").alias("text")).mapInArrow(shingles, "node bigint, shingles binary")
        sets = written(sets, "shingles")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return written(both.mapInArrow(verify, "a bigint, b bigint"), "links")

    sorted_rows = lookups(nodes).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    buckets = many_rows(spark, sorted_rows.mapInArrow(first_of_buckets, "key bigint, node bigint, first bigint, near boolean, pair boolean"), "buckets")
    least = buckets.where("near").groupBy(F.col("node").alias("a")).agg(F.min("first").alias("b"))
    found = linked(least.unionByName(buckets.where("pair").select(F.col("node").alias("a"), F.col("first").alias("b"))).distinct())
    groups = connected_components(found)
    more = linked(left_to_compare(buckets, groups, nodes).distinct())
    return connected_components(found.unionByName(more)) if more.take(1) else groups


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of each group of texts the row with the least id stays.

    Texts are linked if their shingle sets have a Jaccard similarity of `similarity` (0.8 or more) or are equal; groups
    are what links connect. Null and empty texts are equal to each other. Ids, of any type that can be ordered, only
    order the rows of a group, a null id before all others, then a hash of the text: different texts stay whether or
    not they share an id or have none. Of rows with equal ids and texts one stays, whichever. Other columns may have
    any name; an empty table gives an empty table.
    """
    if similarity < 0.8:
        raise ValueError("fingerprints are made for a similarity of 0.8 or more")
    text_batches(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col)
    rows = written(prints(docs, ident, text, words_per_shingle), "prints")
    one = F.min(F.struct("id", "h1", "h2")).alias("one")
    nodes = rows.groupBy("key").agg(one, *(F.first(c).alias(c) for c in ("size", "print", "least")))
    # numbered in the order of ids: the first text of a bucket is the one that came first, more often the origin of the others
    nodes = nodes.drop("key").repartitionByRange("one").sortWithinPartitions("one")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = near_copies(docs, rows, nodes, ident, text, words_per_shingle, similarity)
    of_group = nodes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group"))
    h1, h2, place = (free_name(docs, x) for x in ("h1", "h2", "place"))
    kept = of_group.agg(F.min("one").alias("one")).select(F.col("one.id").alias("id"), F.col("one.h1").alias(h1), F.col("one.h2").alias(h2))
    kept = written(kept, "kept")
    marked = docs.withColumns(dict(zip((h1, h2), text_hashes(text)))).alias("d")
    same = (F.col(f"d.{h1}") == kept[h1]) & (F.col(f"d.{h2}") == kept[h2]) & ident.eqNullSafe(kept["id"])
    left = marked.join(kept.hint("merge"), same, "left_semi")
    by = Window.partitionBy(h1, h2, id_col).orderBy(h1)
    return left.withColumn(place, F.row_number().over(by)).where(F.col(place) == 1).select(*docs.columns)
