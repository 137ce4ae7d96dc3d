"""Operators against plain Python over random pages."""

import difflib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as G
from quire.operators import alignment, layer, matching, ordering, refine, responses
from quire.operators.similarity import similar

BOX = T.StructType([T.StructField(e, T.DoubleType()) for e in G.EDGES])
BOXES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("box_idx", T.IntegerType()), T.StructField("box", BOX), T.StructField("text", T.StringType())])


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def some_box(rng, grid=None):
    if grid:
        x, y = rng.randrange(grid) / grid, rng.randrange(grid) / grid
        return (x, y, x + rng.choice([1, 2]) / grid, y + rng.choice([1, 2]) / grid)
    x, y = rng.random() * 0.8, rng.random() * 0.8
    return (x, y, x + rng.random() * 0.3 + 1e-3, y + rng.random() * 0.3 + 1e-3)


def test_greedy_matches(spark):
    rng = random.Random(1)
    docs = {d: ([some_box(rng, 6) for _ in range(rng.randint(1, 8))], [some_box(rng, 6) for _ in range(rng.randint(0, 8))]) for d in range(60)}
    rows = lambda k: [(d, i, b, "") for d, x in docs.items() for i, b in enumerate(x[k])]
    found = matching.greedy_matches(spark.createDataFrame(rows(0), BOXES), spark.createDataFrame(rows(1), BOXES)).collect()
    got = {(r.doc_id, r.gt_idx): (r.pred_idx, r.iou) for r in found}
    for d, (truth, pred) in docs.items():
        used = set()
        for i, a in enumerate(truth):
            best, score = None, 0.0
            for k, b in enumerate(pred):
                if k not in used and iou(a, b) > score:
                    best, score = k, iou(a, b)
            if score >= 0.3:
                used.add(best)
            p, v = got.pop((d, i))
            assert p == (best if score >= 0.3 else None) and v == pytest.approx(score)
    assert not got


def column_order(boxes):
    key = lambda i: (boxes[i][1], boxes[i][0], i)

    def split(own):
        if len(own) < 4:
            return sorted(own, key=key)
        centre = lambda i: (boxes[i][0] + boxes[i][2]) / 2
        own = sorted(own, key=lambda i: (centre(i), i))
        gaps = [centre(b) - centre(a) for a, b in itertools.pairwise(own)]
        widest = max([0.0, *gaps])
        at = gaps.index(widest) + 1 if widest > 0 else -1
        if widest < 0.2 or at < 2 or at > len(own) - 2:
            return sorted(own, key=key)
        return split(own[:at]) + split(own[at:])

    return split(list(range(len(boxes))))


def test_column_major(spark):
    rng = random.Random(2)
    docs = {}
    for d in range(60):
        columns = rng.choice([[0.3], [0.1, 0.6], [0.05, 0.37, 0.7], [0.1, 0.5]])
        docs[d] = [(x, y, x + 0.1, y + 0.02) for x, y in ((rng.choice(columns), rng.randrange(20) / 20) for _ in range(rng.randint(1, 14)))]
    df = spark.createDataFrame([(d, i, b, "") for d, bs in docs.items() for i, b in enumerate(bs)], BOXES)
    ranks = {(r.doc_id, r.box_idx): (r.row_rank, r.column_rank) for r in ordering.row_major(df).join(ordering.column_major(df).select("doc_id", "box_idx", "column_rank"), ["doc_id", "box_idx"]).collect()}
    for d, bs in docs.items():
        assert [i for i, _ in sorted(((i, ranks[d, i][1]) for i in range(len(bs))), key=lambda x: x[1])] == column_order(bs)
        assert [i for i, _ in sorted(((i, ranks[d, i][0]) for i in range(len(bs))), key=lambda x: x[1])] == sorted(range(len(bs)), key=lambda i: (bs[i][1], bs[i][0], i))


def least_cost(lengths, areas):
    """The cheapest monotone matching by trying all of them."""
    wanted = [max(1.0, e) for e in alignment.expected_chars(areas, max(1, sum(lengths)))]
    cost = lambda a, e: (a - e) / a if a > e else (e - a) / e * 0.5
    best = None
    for k in range(min(len(lengths), len(areas)) + 1):
        for ls in itertools.combinations(range(len(lengths)), k):
            for bs in itertools.combinations(range(len(areas)), k):
                c = sum(cost(max(1, lengths[i]), wanted[j]) for i, j in zip(ls, bs)) + (len(lengths) - k) * 1.0 + (len(areas) - k) * 0.4
                best = c if best is None else min(best, c)
    return best


def test_alignment_is_cheapest_and_keeps_every_line():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.choice([0, 1, 5, 40, 90]) for _ in range(rng.randint(1, 5))]
        areas = [rng.choice([1e-6, 0.01, 0.02, 0.1]) for _ in range(rng.randint(1, 5))]
        cost, out, matches = alignment.align(lengths, areas)
        assert cost == pytest.approx(least_cost(lengths, areas))
        assert [i for i, _ in out] == list(range(len(lengths))) and [j for _, j in out] == sorted(j for _, j in out)
        assert 0 <= matches <= min(len(lengths), len(areas))


def test_pages_without_lines_or_boxes(spark):
    pages = spark.createDataFrame(
        [(1, [], [0.1, 0.1], [0, 1], [0, 1]), (2, [5], [], [], []), (3, [30], [0.01] * 5, list(range(5)), list(range(5))), (4, [5, 5], [0.1, 0.1], [0, 1], [1, 0])],
        "doc_id bigint, lengths array<int>, areas array<double>, by_row array<int>, by_column array<int>",
    )
    found = alignment.aligned_pages(pages)
    lines = spark.createDataFrame([(2, 0, "hello"), (3, 0, "one long line"), (4, 0, "first"), (4, 1, "other")], "doc_id bigint, line_idx int, text string")
    boxes = spark.createDataFrame([(d, i) for d, n in ((1, 2), (3, 5), (4, 2)) for i in range(n)], "doc_id bigint, box_idx int")
    got = sorted(tuple(r) for r in alignment.aligned_text(lines, found).collect())
    assert got == [(1, 0, ""), (1, 1, ""), (2, -1, "hello"), (3, -1, "one long line"), (4, 0, "first"), (4, 1, "other")]


def test_refined_duplicates(spark):
    texts = ["Total due", " total  DUE ", "other", "total due now", "far", "x", "y", "z", "w", "total due", "", "unique"]
    again = {1, 9, 10, 11}
    rows = [(1, i, (0.0, 0.0, 1.0, 1.0), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, BOXES).withColumn("refined", F.col("box_idx").isin(*again))
    out = {r.box_idx: r.text for r in refine.without_duplicates(df).collect()}
    assert out[1] == "" and out[9] == "total due" and out[11] == "unique" and out[10] == "" and out[0] == "Total due"


def test_dense_modes(spark):
    rows = [(d, i, (0.0, 0.0, 1.0, 1.0), "") for d, n in ((1, 60), (2, 61)) for i in range(n)]
    df = spark.createDataFrame(rows, BOXES)
    told = lambda mode: {r.doc_id: r.dense for r in refine.dense_pages(df, mode).collect()}
    assert (told("auto"), told("always"), told("never")) == ({1: False, 2: True}, {1: True, 2: True}, {1: False, 2: False})
    with pytest.raises(ValueError):
        refine.dense_pages(df, "maybe")


def test_runaway_lines(spark):
    rows = [(1, i, t) for i, t in enumerate(["head"] + ["loop"] * 100 + ["foot"])] + [(2, i, f"<td>{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, line_idx int, text string")
    out = responses.clipped(df, ["doc_id"], "line_idx").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {1: 22, 2: 30}


def freeform(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id bigint, raw string").withColumn("img_w", F.lit(1000)).withColumn("img_h", F.lit(2000))
    out = {}
    for r in sorted(responses.freeform_blocks(df, ["doc_id"]).collect(), key=lambda r: (r.doc_id, r.block_idx)):
        out.setdefault(r.doc_id, []).append((tuple(round(v, 6) for v in r.box), r.text))
    return [out.get(i, []) for i in range(len(raws))]


def test_freeform_answers(spark):
    good = {"bbox_2d": [100, 200, 300, 400], "content": " hi "}
    want = [((0.1, 0.1, 0.3, 0.2), "hi")]
    same = [
        json.dumps([good]), "```json\n" + json.dumps([good]) + "\n```", "``` \n" + json.dumps({"results": [good]}) + "```", "Sure: " + json.dumps([good]) + " done",
        json.dumps({"items": [good]}), json.dumps(good), "```json\n" + json.dumps([good]), json.dumps([{"bbox": ["100", "200", 300, 400.0], "text": "hi"}]),
        json.dumps({"results": "none", "blocks": [good]}), json.dumps([{"bbox_2d": [], "bbox": [100, 200, 300, 400], "content": "", "text": "hi"}]), json.dumps([5, None, good]),
    ]
    nothing = [
        "", "no json", "5", "null", "[1, 2", json.dumps([dict(good, bbox_2d=[300, 200, 100, 400])]), json.dumps([dict(good, bbox_2d=[100, 400, 300, 200])]), json.dumps([dict(good, bbox_2d=[1, 2, 3])]),
        json.dumps([dict(good, content="  ")]), json.dumps([{"content": "x"}]), json.dumps([dict(good, bbox_2d=["a", 1, 2, 3])]),
    ]
    assert freeform(spark, same) == [want] * len(same)
    assert freeform(spark, nothing) == [[]] * len(nothing)


def test_layout_details(spark):
    block = {"label": "text", "content": "a", "bbox_2d": [100, 100, 500, 130]}
    page = {"data_info": {"pages": [{"width": 1000, "height": 1000}]}}
    raws = [json.dumps(page | {"layout_details": x}) for x in ([block], [[block, dict(block, label="image")]], [dict(block, content=" ")], [])]
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id bigint, raw string")
    out = [(r.doc_id, r.text, round(r.box.x0, 3), round(r.box.y1, 3)) for r in responses.detail_blocks(df, ["doc_id"]).collect()]
    assert sorted(out) == [(0, "a", 0.1, 0.13), (1, "a", 0.1, 0.13)]
    bad = spark.createDataFrame([(0, json.dumps({"layout_details": [block]}))], "doc_id bigint, raw string")
    with pytest.raises(Exception, match="no such page"):
        responses.detail_blocks(bad, ["doc_id"]).collect()


def test_ground_truth_and_hosted_rules_differ(spark):
    item = lambda label, text, box, page=0: {"block_content": text, "bbox": box, "block_id": 0, "page_index": page, "block_label": label, "score": 1.0}
    data = {"layout": [item("title", "T", [0, 0, 20, 300]), item("text", "", [40, 0, 60, 300]), item("image", "I", [0, 0, 5, 5]), item("text", "P2", [80, 0, 99, 300], 1), item("text", "gone", [80, 0, 99, 300], 7)], "data_info": {"pages": [{"width": 600, "height": 100}, {"width": 300, "height": 200}], "num_pages": 2}}
    df = spark.createDataFrame([(1, json.dumps({"data": data})), (2, json.dumps(data))], "doc_id bigint, raw string")
    hosted = [(r.doc_id, r.text, r.page_index, round(r.box.x1, 3), round(r.box.y1, 3)) for r in responses.hosted_blocks(df, ["doc_id"]).collect()]
    truth = [(r.doc_id, r.text, r.page_index, round(r.box.x1, 3), round(r.box.y1, 3)) for r in responses.truth_blocks(df, ["doc_id"]).collect()]
    assert sorted(hosted) == sorted((d, *x) for d in (1, 2) for x in (("T", 0, 0.5, 0.2), ("P2", 1, 1.0, 0.495)))
    assert sorted(truth) == sorted((d, *x) for d in (1, 2) for x in (("T", 0, 0.5, 0.2), ("", 0, 0.5, 0.6), ("P2", 1, 0.5, 0.99), ("gone", 7, 0.5, 0.99)))


def cut(b, text, full=False):
    """Tall boxes cut by recursion."""
    words = text.split()
    h, w = (b[3] - b[1]), (b[2] * 612 - b[0] * 612)
    aspect = (b[3] * 792 - b[1] * 792) / max(0.01, w)
    if full or h <= 0.07 or aspect <= 0.2 or len(words) < 2:
        return [(b, text)]
    n = min(3 if h > 0.13 else 2, len(words))
    out = []
    for k in range(n):
        own = " ".join(words[round(k * len(words) / n) : round((k + 1) * len(words) / n)])
        if own:
            out += cut((b[0], b[1] + k * (h / n), b[2], b[1] + (k + 1) * (h / n)), own)
    return out


def test_tall_boxes(spark):
    rng = random.Random(5)
    rows = [(1, i, (x := rng.random() / 2, y := rng.random() / 2, x + rng.choice([0.05, 0.2, 0.5]), min(1.0, y + rng.choice([0.02, 0.08, 0.14, 0.3, 0.5]))), " ".join(f"w{k}" for k in range(rng.randint(1, 9)))) for i in range(120)]
    rows.append((1, 999, (0.0, 0.0, 1.0, 1.0), "one long line of eleven words over the whole page here"))
    df = spark.createDataFrame(rows, BOXES).withColumn("full_page", F.lit(False))
    got = {}
    for r in sorted(layer.tall_slices(df).collect(), key=lambda r: (r.box_idx, r.path)):
        got.setdefault(r.box_idx, []).append((tuple(round(v, 9) for v in r.box), r.text))
    for _, i, b, t in rows:
        assert got[i] == [(tuple(round(v, 9) for v in x), y) for x, y in cut(b, t)]
    assert len(got[999]) == 9


def test_lines_of_a_box(spark):
    rows = [(1, 0, (0.1, 0.2, 0.5, 0.4), "a\n\n b "), (1, 1, (0.0, 0.0, 1.0, 1.0), "x\ny"), (1, 2, (0.1, 0.2, 0.5, 0.4), "only\n "), (1, 3, (0.1, 0.2, 0.5, 0.4), " ")]
    out = sorted((r.box_idx, r.slice_idx, r.text, r.full_page, round(r.box.y0, 3), round(r.box.y1, 3)) for r in layer.line_slices(spark.createDataFrame(rows, BOXES)).collect())
    assert out == [(0, 0, "a", False, 0.2, 0.3), (0, 1, "b", False, 0.3, 0.4), (1, 0, "x\ny", True, 0.0, 1.0), (2, 0, "only", False, 0.2, 0.4)]


def test_similarity_is_that_of_difflib(spark):
    rng = random.Random(6)
    norm = lambda s: " ".join("".join(" " if c in "*_`#-" else c for c in s.lower()).split())
    rows = [("".join(rng.choice("ab *-#C d") for _ in range(rng.randint(0, 300))), "".join(rng.choice("ab *-#C d") for _ in range(rng.randint(0, 300)))) for _ in range(30)] + [("# Same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", similar(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert r.s == pytest.approx(difflib.SequenceMatcher(None, norm(r.a), norm(r.b)).ratio())


def test_diagonals_equal_single_cells():
    import random

    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.choice([0, 1, 5, 20, 60]) for _ in range(rng.randint(1, 40))]
        wanted = [max(1.0, rng.choice([0.5, 3.0, 20.0, 47.25])) for _ in range(rng.randint(1, 40))]
        cost, steps = alignment.steps_of(lengths, wanted)
        other, how = alignment.steps_by_diagonals(lengths, wanted)
        assert cost == other and [list(x) for x in steps] == how.tolist()


def test_alignment_runs_once(spark):
    from quire import catalog

    plan = catalog.QUERIES["n04_align_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
