"""Expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.sources.sinks import natural_width


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*b):
    return G.box(*(F.lit(float(x)) for x in b))


@pytest.mark.parametrize("chars,expected,cost", [(50, 50, 0), (0, 100, 0.495), (50, 100, 0.25), (150, 100, 1 / 3), (200, 100, 0.5), (500, 100, 0.8)])
def test_match_cost(spark, chars, expected, cost):
    assert one(spark, G.match_cost(F.lit(chars), F.lit(float(expected)))) == pytest.approx(cost)


@pytest.mark.parametrize(
    "a,b,v", [((0, 0, 1, 1), (0, 0, 1, 1), 1), ((0, 0, 1, 1), (0.5, 0, 1.5, 1), 1 / 3), ((0, 0, 1, 1), (0.5, 0.5, 1, 1), 0.25), ((0, 0, 0.1, 0.1), (0.5, 0.5, 1, 1), 0), ((0, 0, 0, 0), (0, 0, 1, 1), 0)]
)
def test_iou(spark, a, b, v):
    assert one(spark, G.iou(box(*a), box(*b))) == pytest.approx(v)


def test_rounding_and_clamping(spark):
    assert [one(spark, G.rounded(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5, 2.4)] == [0, 2, 2, 0, 2]
    assert [one(spark, G.clamp(F.lit(x))) for x in (-1.0, 0.5, 7.0, math.nan)] == [0, 0.5, 1, 1]


def test_gates(spark):
    assert [one(spark, G.refinable(box(0, 0, w, h))) for w, h in ((0.03, 0.1), (0.031, 0.008), (0.031, 0.009))] == [False, False, True]
    assert one(spark, G.full_page(box(0, 0, 1, 1), F.lit("a\nb"))) and not one(spark, G.full_page(box(0, 0, 1, 1), F.lit("ab")))


def test_crops(spark):
    c = one(spark, G.crop_rect(box(0.1, 0.1, 0.2, 0.11), F.lit(1000), F.lit(2000)))
    assert (c.x0, c.y0, c.x1, c.y1, c.blank) == (95, 190, 205, 230, False)
    s = one(spark, G.crop_size(F.lit(110.0), F.lit(40.0)))
    assert (s.w, s.h) == (int(110 * 6.4), 256)
    t = one(spark, G.thumbnail(F.lit(2000), F.lit(1000), 1024))
    assert (t.w, t.h) == (1024, 512)


@pytest.mark.parametrize(
    "spec,total,pages",
    [("3", 10, [2]), ("1-3", 10, [0, 1, 2]), ("1-3,5,7-9", 10, [0, 1, 2, 4, 6, 7, 8]), ("8-12", 5, []), ("1,1,2-3,3", 5, [0, 1, 2]), ("3-1", 9, []), (" 2 , ", 9, [1]), ("0", 9, []), ("6-6", 5, [])],
)
def test_page_numbers(spark, spec, total, pages):
    assert one(spark, X.page_numbers(F.lit(spec), F.lit(total))) == pages


@pytest.mark.parametrize("spec", ["-5", "a", "1-b", "1-3-5"])
def test_bad_page_numbers_raise(spark, spec):
    with pytest.raises(Exception):
        one(spark, X.page_numbers(F.lit(spec), F.lit(9)))


SPACES = "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f \x85\xa0       　"


def test_white_space_is_that_of_python(spark):
    assert all(c.isspace() for c in SPACES)
    rng = random.Random(1)
    for _ in range(10):
        t = "".join(rng.choice(SPACES + "abÉ​") for _ in range(30))
        assert one(spark, X.strip(F.lit(t))) == t.strip()
        assert one(spark, X.lines(F.lit(t))) == [s.strip() for s in t.split("\n") if s.strip()]
        assert one(spark, X.dedup_form(F.lit(t))) == " ".join(t.lower().split())


def test_front_matter(spark):
    cases = [
        ("---\nlanguage: en\n---\n\nBody\nmore ", "Body\nmore"), ("no header", "no header"), ("---\nnever closed", "---\nnever closed"), ("  ---\na\n---", ""), ("", ""), ("---", "---"),
    ]
    for raw, body in cases:
        assert one(spark, X.without_front_matter(F.lit(raw))) == body


def test_noise(spark):
    for t in ("lorem ipsum", ' "Lorem Ipsum." ', "“The quick brown fox jumps over the lazy dog!”"):
        assert one(spark, X.crop_text(F.lit(t))) == ""
    for t in ("as lorem ipsum says", "The quick brown fox"):
        assert one(spark, X.crop_text(F.lit(t))) == t


def test_lines_of_items(spark):
    assert one(spark, X.lines_of_items(F.array(F.lit("a\n b"), F.lit(None), F.lit(" "), F.lit("c")))) == ["a", "b", "c"]
    assert one(spark, X.lines_of_items(F.lit(None).cast("array<string>"))) == []


def test_paths(spark):
    for p, image in (("a/b.JPG", True), ("/x/.jpg", False), ("b.tiff", True), ("c.pdf", False), ("d", False), ("e.png.pdf", False)):
        assert one(spark, X.is_image(F.lit(p))) is image
    for p, given, out in (("a/b.pdf", None, "a/b_ocr.pdf"), ("b.tar.gz", "", "b.tar_ocr.pdf"), ("b", None, "b_ocr.pdf"), ("b.pdf", "o.pdf", "o.pdf")):
        assert one(spark, X.output_path(F.lit(p), F.lit(given))) == out


def test_natural_width(spark):
    assert one(spark, natural_width(F.lit("Hi W"), F.lit(10.0))) == pytest.approx((722 + 222 + 278 + 944) / 100)
    assert one(spark, natural_width(F.lit(""), F.lit(10.0))) == 0
