"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder of shards that follow each other in ascending document id. `tokens-N.bin` holds the shard's ids
end to end, as little-endian uint16 where the vocabulary allows it and as uint32 otherwise; `docs-N.bin` holds the int64
document ids and `offsets-N.bin` their int64 starts in the whole data set, and one more for the end. The start of each
shard is the sum of the shards before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.files import mapped, write_whole
from quire.llm.shared import new_folder, text_batches

END = 0
NO_ID = -(1 << 63)
#: Pieces of text with known ids that a worker keeps; it starts afresh beyond.
KNOWN = 1_000_000


class Encoder:
    """Ids of whole texts, from the tokenizers library.

    A byte-level vocabulary splits a text before every single space between two other characters, whatever surrounds
    it, so that such pieces have the same ids everywhere: each different piece goes through the library once. Texts
    with other white space around a space go through it as a whole.
    """

    def __init__(self, vocabulary: str, remember: int):
        from tokenizers import Tokenizer

        self.remember = remember
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([END], self.kind).tobytes()
        self.known: dict[str, bytes] = {}  # pieces that follow a space
        self.stops = dict(zip(",.", self._encode([",", "."])))
        self.pieces_ok = self._splits_at_spaces()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(names.values()) + 1, np.int64)
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        for name, i in names.items():  # a byte-level token has a character for each byte
            self.lengths[i] = len(name.encode()) if name in added else len(name)

    def _splits_at_spaces(self) -> bool:
        import json

        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        return made.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not any(x["lstrip"] or x["rstrip"] for x in made.get("added_tokens", []))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that follow a space: all in one text, cut where the tokens' lengths add up to the pieces'."""
        joined = " " + " ".join(pieces)
        (whole,) = self._encode([joined])
        ids = np.frombuffer(whole, self.kind)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(x.encode()) + 1 for x in pieces])
        at = np.searchsorted(ends, wanted)
        if len(ends) and (at < len(ends)).all() and (ends[at] == wanted).all() and ends[-1] == wanted[-1]:
            cuts = [0, *((at + 1) * self.kind.itemsize).tolist()]
            self.known.update(zip(pieces, [whole[x:y] for x, y in zip(cuts, cuts[1:])]))
        else:
            self.known.update(zip(pieces, self._encode([" " + x for x in pieces])))

    def _learn_all(self, new: set[str]) -> None:
        """A comma or full stop after a letter has its own id: what stands before it is looked up or learned instead."""
        ended = {x for x in new if len(x) > 1 and x[-1] in self.stops and x[-2].isalpha() and x[-2] < "\u0250"}
        if plain := list((new - ended) | ({x[:-1] for x in ended}.difference(self.known))):
            self._learn(plain)
        self.known.update((x, self.known[x[:-1]] + self.stops[x[-1]]) for x in ended)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, end id included, as bytes."""
        if not self.pieces_ok:
            return [x + self.end for x in self._encode([t or "" for t in texts])]
        split = [t.split(" ") if t else [] for t in texts]
        whole = [i for i, p in enumerate(split) if p and (not p[0] or p[0][-1].isspace())]
        firsts = [p[0] if p else "" for p in split]
        rest = [p[1:] for p in split]
        new = set().union(*rest).difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = set().union(*rest)
        if odd := {x for x in new if not x or x[0].isspace() or x[-1].isspace()}:
            whole += [i for i, p in enumerate(rest) if not odd.isdisjoint(p)]
            new -= odd
        if new:
            self._learn_all(new)
        begun = dict(zip(own := list(set(firsts)), self._encode(own)))
        whole = dict(zip(own := sorted(set(whole)), self._encode([texts[i] for i in own]))) if whole else {}
        known = self.known.__getitem__
        return [whole[i] + self.end if i in whole else b"".join((begun[firsts[i]], *map(known, p), self.end)) for i, p in enumerate(rest)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, remember: int = KNOWN) -> Encoder:
    if (vocabulary, remember) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary, remember] = Encoder(vocabulary, remember)
    return _encoders[vocabulary, remember]


def write_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shards: int | None = None, remember: int = KNOWN
) -> DataFrame:
    """Writes the data set and returns its manifest (shard, n_docs, n_tokens, base, folder, kind): one row per shard.

    Shards are ranges of ids between quantiles. Texts are encoded before rows move, so that ids travel, compressed.
    Null texts are empty; each document ends with id 0. Rows with equal ids are ordered by their length and ids; null
    document ids come last and are stored as the least int64. An empty table gives an empty data set. A worker
    remembers the ids of up to `remember` pieces of text: more of them take memory and save time, nothing else.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col), at, 10_000)).first()[0] if at else []
    cuts = np.unique(np.array(bounds or [], np.int64))
    shards = len(cuts) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pack = encoder(vocabulary, remember), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                ids = of(some.column(1).to_pylist())
                shard = [shards - 1 if x is None else int(np.searchsorted(cuts, x, "left")) for x in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(shard, pa.int32()), pa.array([len(x) // of.kind.itemsize for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())],
                    ["doc_id", "shard", "n", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # all texts are encoded by now; what a worker remembers of them would stay
        names: list[int] = []
        sizes: list[int] = []
        unpack = zstandard.ZstdDecompressor()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def chunks():
            for batch in (b for part in ([first], batches) for b in part):
                names.extend(NO_ID if x is None else x for x in batch.column(0).to_pylist())
                sizes.extend(batch.column(2).to_pylist())
                for x in batch.column(3):
                    yield unpack.decompress(x.as_py())

        shard = first.column(1)[0].as_py()
        write_whole(f"{folder}/tokens-{shard:06d}.bin", chunks())
        write_whole(f"{folder}/docs-{shard:06d}.bin", [np.array(names, "<i8").tobytes()])
        write_whole(f"{folder}/sizes-{shard:06d}.bin", [np.array(sizes, "<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["shard", "n_docs", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {kind}, shard int, n bigint, ids binary")
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "n", "ids")
    # one row per shard: the only thing that comes to the driver
    manifest = sorted(dealt.mapInArrow(write, "shard int, n_docs bigint, n_tokens bigint").collect())
    kind_of_ids = Encoder(vocabulary, 0).kind.str
    bases = np.cumsum([0, *(x.n_tokens for x in manifest)])
    rows = [(x.shard, x.n_docs, x.n_tokens, int(b), folder, kind_of_ids) for x, b in zip(manifest, bases)]
    made = spark.createDataFrame(rows, "shard int, n_docs bigint, n_tokens bigint, base bigint, folder string, kind string").repartition(max(1, len(rows)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                sizes = mapped(f"{x['folder']}/sizes-{x['shard']:06d}.bin", np.dtype("<i8"))
                starts = x["base"] + np.concatenate([[0], np.cumsum(sizes)])
                write_whole(f"{x['folder']}/offsets-{x['shard']:06d}.bin", [starts.astype("<i8").tobytes()])
            yield batch

    made.mapInArrow(index, made.schema).write.format("noop").mode("overwrite").save()
    return made


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; the checksum is over uint32 ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = mapped(f"{x['folder']}/tokens-{x['shard']:06d}.bin", np.dtype(x["kind"]))
                names = mapped(f"{x['folder']}/docs-{x['shard']:06d}.bin", np.dtype("<i8"))
                starts = mapped(f"{x['folder']}/offsets-{x['shard']:06d}.bin", np.dtype("<i8"))
                for at in range(0, len(names), 4096):
                    own = names[at : at + 4096]
                    cuts = starts[at : at + len(own) + 1]
                    crc = [zlib.crc32(ids[a - x["base"] : b - x["base"]].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NO_ID), pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
