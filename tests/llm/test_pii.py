"""Personal data against plain regular expressions, and the aggregation of votes against known truth."""

import hashlib
import random
import re

from pyspark.sql import types as T

from quire.llm.pii import ADDED, classifier, personal_data, reliabilities

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("email", T.StringType())])
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keep(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if keep(k, m[0])]


def texts():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y@mail.example.com", "@", ".", "..", "_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.255", "9.9.9.9.9.9.9.9", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "+1 (974) 555-3436", "+49.30 1234567", "+", "é😀", "\n", " ", "-", "0", "word", "call 555", "(212) 555-0187", "joe (at) site (dot) com", 'token = "04dbebab91ab85687d33eeaaf9ac699e"', "12345678901234567890", "6 6 6 6", "\x1f", "٣٤", "é@ü.com"]
    out = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    out += ["1 " * 20_000, "a." * 20_000 + "@" + "b.c" * 5_000, "1." * 20_000, "+1" + " 2" * 20_000, "a" * 60_000, "é " * 30_000 + "a@b.co"]
    return out


def test_base_equals_regular_expressions(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(9000, None), (9001, ""), (None, "a@b.c"), (0, "again a@b.c"), (9001, "")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    found = personal_data(docs).collect()

    def row(d, text):
        spans = plain(text)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        return (d, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(base.encode()).hexdigest())

    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((row(*r) for r in rows), key=str)
    text = dict(rows)
    order = {k: i for i, k in enumerate([*PATTERNS, *ADDED])}
    for r in found:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (order[x[0]], x[1]))
        if r.doc_id not in (None, 0):
            base = [x for x in spans if x[0] in PATTERNS]
            assert base == plain(text[r.doc_id]) and len(spans) - len(base) == r.n_added
            assert not [1 for k, s, e in spans if k in ADDED for _, a, b in base if a < e and s < b]
    assert sum(r.n_added for r in found) > 20
    assert personal_data(docs.limit(0)).collect() == []


def test_votes_find_the_truth():
    rng = random.Random(9)
    counts = {}
    truth = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple(-1 if rng.random() < 0.2 else int(y) if rng.random() < p else int(not y) for p in (0.95, 0.9, 0.85, 0.7, 0.5))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    rows = [(0, v, n) for v, n in sorted(counts.items())]
    post = reliabilities(rows)
    right = sum(sum(y == (p > 0.5) for y in truth[v]) for (_, v, _), p in zip(rows, post))
    assert right / 4000 > 0.95
    w = classifier(rows)
    assert w[len(ADDED)] > w[len(ADDED) + 3] > w[len(ADDED) + 4] - 0.2
    assert not classifier([]).any()


def test_added_spans_have_precision_and_recall(spark):
    """From texts to added spans: planted ones are found, look-alikes are not."""
    rng = random.Random(10)
    letters = "0123456789abcdef"
    secret = lambda n: "".join(rng.choice(letters) for _ in range(n - 2)) + "a7"

    def luhn(start, n):
        d = start + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(start)))
        total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
        return d + str(-total % 10)

    good = {
        "credential": lambda: f'{rng.choice(["token", "api_key", "password"])} = "{secret(rng.choice([32, 40, 400]))}"',
        "contact": lambda: f"{rng.choice(['mail', 'write to', 'see'])} {secret(5)} (at) site{rng.randrange(99)} (dot) {rng.choice(['com', 'de'])}",
        "local_phone": lambda: f"{rng.choice(['call', 'phone', ''])} ({rng.choice('23456789')}{rng.choice('02345678')}{rng.choice('02345')}) {rng.choice('23456789')}{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "account": lambda: f"{rng.choice(['visa', 'account', 'pay with'])} {luhn('37', 15)}",
    }
    bad = {
        "credential": lambda: f"key: {'x' * 16}",
        "contact": lambda: f"meet [at) {rng.randrange(9)}.{rng.randrange(9)}",
        "local_phone": lambda: f"part no 911.1{rng.randrange(10, 99)} {rng.randrange(1000, 9999)}",
        "account": lambda: f"order {9000000000000000 + rng.randrange(10**13) * 10 + 1}",
    }
    rows, planted = [], set()
    for i in range(1200):
        kind, real = rng.choice(list(good)), rng.random() < 0.6
        piece = (good if real else bad)[kind]()
        rows.append((i, f"words before {piece} and after", "", ""))
        if real:
            planted.add((i, kind))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {(r.doc_id, x.split(":")[0]) for r in personal_data(docs).collect() for x in r.spans.split(",") if x.split(":")[0] in ADDED}
    assert len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.95 * len(found)
    long = personal_data(spark.createDataFrame([(1, rows[0][1], "", "")] + [(2, f'token = "{secret(400)}"', "", "")] * 9, SCHEMA)).collect()
    assert {r.spans for r in long if r.doc_id == 2} == {"credential:0:409"}
    many = personal_data(spark.createDataFrame([(1, "a@b.co " * 3000, "", "")], SCHEMA)).first()
    assert many.n_email == many.n_spans == 3000 and many.spans.endswith(f"email:{7 * 2999}:{7 * 2999 + 6}")
