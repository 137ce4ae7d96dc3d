"""Repeats against every substring, and suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import repeats
from quire.llm.repeats import first_least, substring_hashes, without_repeats
from quire.llm.shared import least
from quire.llm.suffixes import suffix_array

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n1", T.StringType()), T.StructField("sha", T.StringType())])


def test_suffix_arrays_equal_sorting():
    rng = random.Random(11)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))]
        s = (s[:4] * 20)[: len(s)] if rng.random() < 0.3 else s
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_numpy_parts():
    rng = np.random.default_rng(12)
    data = rng.integers(0, 3, 300).astype(np.uint8)
    for k in (1, 2, 7, 64, 200):
        h = substring_hashes(data, k)
        named = {}
        for i in range(len(data) - k + 1):
            assert named.setdefault(data[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(named.values())) == len(named)
    v = rng.integers(0, 9, 100)
    for w in (1, 2, 3, 41, 100):
        assert first_least(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


def plain(rows):
    texts = [(t or "").encode() for _, t in rows]
    n = repeats.LENGTH
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(g and not h for g, h in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed, n, common):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "é", "on", "an", "漢"]) for _ in range(rng.randint(1, 3)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.choice([50, 90, 130, 200])) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [text(rng.choice([0, 1, 3, 30, 120]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = passages[0] if rng.random() < common else rng.choice(passages)
            at = rng.choice([0, 0, 7, 60])
            parts += [p[at : rng.choice([None, None, len(p) - 11])], text(rng.choice([0, 1, 2, 40]))]
        rows.append((i, rng.choice([" ", ""]).join(parts)))
    for i in range(0, n, 9):
        x = rows[i][1]
        at = rng.randrange(len(x) + 1)
        rows.append((1000 + i, x[:at] + rng.choice(["", "x", word()]) + x[at + 1 :]))
    return rows


@pytest.mark.parametrize("group", [1024, 3])
def test_rows_equal_every_substring(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = fixture(13, 60, 0.7)
    rows += [(5000, None), (5001, ""), (5002, "a" * 1000), (5003, "ab" * 300), (5004, "x" * 399), (5005, "x" * 399), (5006, "y" * 400), (None, rows[3][1]), rows[4], rows[4]]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    found = without_repeats(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == plain(rows)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed and len(r.removed) == r.n_spans for r in found)
    # anchors that other texts hold: never without a common string of their length, and always with one of LENGTH
    def strings(k):
        texts = Counter((t or "").encode() for _, t in rows)
        own = {t: {t[i : i + k] for i in range(len(t) - k + 1)} for t in texts if len(t) >= repeats.LENGTH}
        every = Counter(x for o in own.values() for x in o)
        return {t: texts[t] > 1 or any(every[x] > 1 for x in o) for t, o in own.items()}

    may, must = strings(repeats.ANCHORS[0]), strings(repeats.LENGTH)
    for r in found:
        t = next((t or "").encode() for d, t in rows if d == r.doc_id)
        assert must.get(t, False) <= (r.n_shared > 0) <= may.get(t, False)


def test_common_windows_equal_every_window(spark):
    rng = random.Random(17)
    text = lambda k: " ".join(rng.choice(["a", "of", "é", "word", "wörd", "漢字"]) + str(rng.randrange(9)) for _ in range(k))
    passages = [text(k) for k in (50, 51, 52, 60, 140)]
    rows = [(i, rng.choice([" ", "\n\t"]).join([text(rng.choice([0, 5, 70])), rng.choice(passages), text(rng.choice([0, 3, 60])), rng.choice([rng.choice(passages), ""])])) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "x " * 200), (903, text(30)), (904, rows[0][1]), (905, passages[0]), (906, passages[0]), (907, long := text(70)), (None, long), (909, rows[5][1] + " z")]
    held = Counter()
    windows = lambda t: [tuple(w[i : i + 51]) for w in [(t or "").encode().split()] for i in range(len(w) - 50)]
    for _, t in rows:
        held.update(set(windows(t)))
    wanted = {d: sum(held[w] > 1 for w in windows(t)) for d, t in rows}
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    assert {r.doc_id: r.n_common for r in without_repeats(docs).collect()} == wanted
    assert 0 in wanted.values() and 1 in wanted.values() and wanted[None] == 20


def test_least_at_depends_on_the_window_alone():
    rng = np.random.default_rng(19)
    upper = rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(32)  # ties in the upper halves go to the first
    hashes = upper | rng.integers(0, 1 << 32, 500).astype(np.uint64)
    for w in (1, 2, 44, 201, 499, 500):
        assert repeats.least_at(hashes, w).tolist() == first_least(upper, w).tolist()


def test_suffix_arrays_hold_only_letters_that_may_repeat(monkeypatch):
    rng = random.Random(23)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    anchor, passage, members = some(200), some(450), []
    for _ in range(3):  # around the anchor alike in fewer bytes than LENGTH
        members.append((0, 101, 150, some(150) + anchor + some(150)))
    for left, right in ((60, 9), (90, 0), (0, 5)):
        members.append((1, 51 + left + right, left + 60, some(left) + passage + some(right)))
    members.append((2, 51, 60, passage))  # the same letters in another group
    held = []
    monkeypatch.setattr(repeats, "suffix_array", lambda text: held.append(len(text)) or suffix_array(text))
    found = [set(np.flatnonzero(x).tolist()) for x in repeats.repeated_starts(members, 200)]
    assert found == [set(), set(), set(), set(range(60, 111)), set(range(90, 141)), set(range(51)), set()]
    assert held == [3 * (51 + 201)]
    assert not any(x.any() for x in repeats.repeated_starts(members[:3], 200)) and len(held) == 1


def test_least_rows_need_no_sort(spark):
    rows = spark.createDataFrame([(1, 7, 3), (1, 5, 9), (2, 4, 4)], "a int, n bigint, p int")
    found = rows.groupBy("a").agg(least("n", "p").alias("one"))
    assert {(r.a, r.one.n, r.one.p) for r in found.collect()} == {(1, 5, 9), (2, 4, 4)}
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
