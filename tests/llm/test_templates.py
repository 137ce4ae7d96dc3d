"""Template windows: planted items are found, others are not, slots must be consistent."""

import random
import re

import pytest
from pyspark.sql import types as T

from quire.llm.templates import PUNCTUATION, SENTENCE_ENDS, UNITS, Words, leaks, templates, windows, without_leaks

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("h1", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
QUESTION = "A train leaves the old station with Anna at 12 km and returns to Anna after 30 minutes, so how far did 12 people ride?"
CHANGED = "A train leaves the old station with Bert at 15 km and returns to Bert after 45 minutes, so how far did 15 people ride?"
BROKEN = "A train leaves the old station with Bert at 15 km and returns to Carl after 45 minutes, so how far did 99 people ride?"


def tables(spark, rows, items):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3), spark.createDataFrame(items, ITEMS)


@pytest.fixture(scope="module")
def one(spark):
    """(item, other values) of each of many (text, items) cases, in one query each way."""

    def found(cases):
        rows = [(i, text) for i, (text, _) in enumerate(cases)]
        items = [(1000 * i + k, x) for i, (_, own) in enumerate(cases) for k, x in enumerate(own)]
        got = leaks(*tables(spark, rows, items)).collect()
        return [sorted((r.item_id % 1000, r.other_values) for r in got if r.doc_id == i and r.item_id // 1000 == i) for i in range(len(cases))]

    return found


def test_slots_and_words_before(one):
    river = "Which river flows past the old town of Anna?"
    apples = "John has 5 apples. Mary has 3 apples. How many apples do they have together?"
    names = "The prize of 40 euros went to Ann Smith who shared it with nobody else at all"
    cases = [
        (f"Here it comes. {QUESTION} Then more.", [QUESTION], [(0, False)]),
        (f"well: {CHANGED}", [QUESTION], [(0, True)]),
        (BROKEN, [QUESTION], []),
        ("A train leaves the old station.", [QUESTION], []),
        (None, [QUESTION], []),
        ("", [QUESTION], []),
        ("###", [QUESTION], []),
        ("so: two times three is!", ["two times three"], [(0, False)]),
        ("x", [None, "", "a b"], []),
        ("So: Peter has 6 apples. Paul has 4 apples. How many apples do they have together?", [apples], [(0, True)]),
        ("Peter has 6 apples. Peter has 4 apples. How", [apples], []),
        (names.replace("Ann Smith", "Bob Lee Jones"), [names], [(0, True)]),
        ("Compute 13 + 34 * 56 - 78", ["Compute 12 + 34 * 56 - 78"], []),
        ("前面有字水的沸点是多少度后面也有", ["水的沸点是多少度"], [(0, False)]),
        ("12 34 56 78 90 11 22 33 44 55", ["12 34 56 78 90 11 22 33 44 55"], [(0, False)]),
        ("What is 12 + 30 - 4 * 7 / 2 ?", ["What is 12 + 30 - 4 * 7 / 2 ?"], [(0, False)]),
    ]
    for before in ("A heading\n", "- ", "Question 5 ", "he asked, ", '"', ""):
        cases += [(f"{before}{river}", [river], [(0, False)]), (f"{before}{river.replace('Anna', 'Bert')}", [river], [(0, True)])]
    for item in ("Compute 12 + 34 * 56 - 78", "What Is The Capital Of France", "3 5 8 13 21 34 55 89 144 233 377", "Paris", "Why not?", "水的沸点是多少度"):
        cases.append((f"Words before it, {item}, and after", [item], [(0, False)]))
    assert one([c[:2] for c in cases]) == [c[2] for c in cases]


def test_windows_are_content_only():
    words = Words()
    a, b = templates([["x", "a", "b"], ["c"]], words)[0], templates([["a", "b", "c"]], words)[0]
    assert list(windows(a.hashes, 2))[1] == list(windows(b.hashes, 2))[0]
    assert len(windows(b.hashes, 4)) == 0 and windows(b.hashes, 2, 1)[0] != windows(b.hashes, 2)[0]


def plain_template(text, lookup):
    """[(kind or word, value)] of a text, by plain rules; lookups are typed, wide and plain."""
    out, number, ended, last = [], False, True, None
    for i, w in enumerate((text or "").split()):
        core = w.strip(PUNCTUATION)
        is_number = bool(re.fullmatch(r"[+-]?\d[\d.,:/]*", core) or ((m := re.fullmatch(r"\d[\d.,]*([^\W\d_]+)", core)) and m[1].lower() in UNITS))
        kind = ""
        if core and lookup < 2:
            name = core[0].isupper() and (lookup == 1 or (not ended and i > 0))
            kind = "number" if is_number else "unit" if core.lower() in UNITS and number else "name" if name else ""
        if core:
            if kind == "name" and last == "name":
                out[-1] = ("name", out[-1][1] + " " + core.lower())
            else:
                out.append((kind or core.lower(), core.lower()))
            last = kind
        number = is_number
        tail = w.rstrip("\"'”’)»")
        ended = tail[-1:] in SENTENCE_ENDS and bool(tail)
    return out


KINDS = {"number", "unit", "name"}


def plain(rows, items):
    """Every text against every item and offset."""
    out = []
    for d, t in rows:
        for item, text in items:
            if any(matched(plain_template(t, k), plain_template(text, k), k) for k in range(3)):
                out.append((d, item))
    return sorted(out, key=str)


def matched(text, item, lookup):
    n = min(8, len(item))
    if not n:
        return False
    starts = [s for s in range(len(item) - n + 1) if lookup == 2 or (n >= 3 and 2 * sum(k not in KINDS for k, _ in item[s : s + n]) >= n)]
    by_shift = {}
    for at in range(len(text) - n + 1):
        for s in starts:
            if [k for k, _ in text[at : at + n]] == [k for k, _ in item[s : s + n]]:
                by_shift.setdefault(at - s, set()).add(s)
    for shift, own in by_shift.items():
        slots = {(item[s + k][1], text[shift + s + k][1]) for s in own for k in range(n) if item[s + k][0] in KINDS and lookup < 2}
        if len(own) >= min(3, len(starts)) and len({x for x, _ in slots}) == len({y for _, y in slots}) == len(slots):
            return True
    return False


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ka", "lo", "mi", "tu"]) + rng.choice(["ra", "ti", "lu"]) + rng.choice(["", "x"])
    name = lambda: " ".join(word().title() for _ in range(rng.choice([1, 1, 2])))
    number = lambda: str(rng.randrange(30)) + rng.choice(["", " km", " kg", "."])
    text = lambda n: " ".join(rng.choice([word, word, word, word, name, number])() + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    def again(t):
        """The same question with other values, each changed alike, or one of them not alike."""
        new = {}
        words = [new.setdefault(w, f"{name()}" if w[0].isupper() else str(rng.randrange(30, 60))) if w[0].isupper() or w.isdigit() else w for w in t.split()]
        if rng.random() < 0.3:
            words = [str(rng.randrange(60, 90)) if w.isdigit() and rng.random() < 0.5 else w for w in words]
        return " ".join(words)

    items = [(i, text(rng.choice([2, 9, 15, 30]))) for i in range(30)]
    rows = []
    for i in range(200):
        body = [text(rng.choice([0, 5, 40])), text(rng.choice([0, 20]))]
        if i % 3:
            own = rng.choice(items)[1]
            own = (again(own) if i % 3 == 1 else own).split()
            at = rng.randrange(max(1, len(own) - 12))
            body.insert(1, " ".join(own[at : at + rng.choice([8, 11, 60])]))
        rows.append((i, "  ".join(body)))
    rows += [(200, None), (201, ""), (None, items[3][1]), rows[1], (202, text(3_000) + " " + items[4][1])]
    items += [(77, items[4][1])]
    docs, bench = tables(spark, rows, items + [(None, "nothing like it stands anywhere at all in here")])
    found = sorted(((r.doc_id, r.item_id) for r in leaks(docs, bench).collect()), key=str)
    assert found == plain(rows, items) and 60 < len(found) < len(rows) * len(items) / 2
    hit = {t for d, t in rows if any(d == x for x, _ in found)}
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for r in rows if r[1] not in hit), key=str)
    assert leaks(docs.limit(0), bench).collect() == [] and leaks(docs, bench.limit(0)).collect() == []
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_any_ids(spark):
    docs = spark.createDataFrame([("a", f"so {QUESTION}"), (None, QUESTION), ("b", "no")], "doc_id string, text string")
    bench = spark.createDataFrame([("q", QUESTION), (None, QUESTION)], "item_id string, text string")
    assert sorted(((r.doc_id, r.item_id) for r in leaks(docs, bench).collect()), key=str) == sorted([(d, i) for d in ("a", None) for i in ("q", None)], key=str)
