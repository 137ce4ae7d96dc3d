"""Boxes as Catalyst expressions: structs of four doubles x0, y0, x1, y1, in 0..1 from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")

# Fixed values
MIN_AREA = 1e-6
REFINE_WIDTH, REFINE_HEIGHT = 0.03, 0.008
CROP_PAD, CROP_SIDE = 0.005, 256
ASCENDER, DESCENDER = 1.075, -0.299
FONT_LEAST, FONT_MOST = 3.0, 72.0
FILL = 0.98
TALL, VERY_TALL, TALL_ASPECT = 0.07, 0.13, 0.20
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
TEXTBOX_INSET, TEXTBOX_FONT = 10.0, 6.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), EDGES)))


def clamp(v: Column) -> Column:
    """Into 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def normalized(b: Column, width: Column, height: Column) -> Column:
    """Pixels to 0..1; a zero side raises, as a division does."""
    return box(clamp(b["x0"] / width), clamp(b["y0"] / height), clamp(b["x1"] / width), clamp(b["y1"] / height))


def scaled(b: Column, width: Column, height: Column) -> Column:
    return box(b["x0"] * width, b["y0"] * height, b["x1"] * width, b["y1"] * height)


def rounded(v: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(v).cast("int")


def swapped(b: Column) -> Column:
    """y, x, y, x to x, y, x, y, or back."""
    return box(b["y0"], b["x0"], b["y1"], b["x1"])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def capacity(b: Column) -> Column:
    """How much text a box may hold, by its area."""
    return F.greatest(F.lit(MIN_AREA), area(b))


def overlap(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet or have no area."""
    side = lambda x, lo, hi: F.greatest(F.lit(0.0), x[hi] - x[lo])
    inter = overlap(a, b)
    union = side(a, "x0", "x1") * side(a, "y0", "y1") + side(b, "x0", "x1") * side(b, "y0", "y1") - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / F.when(union > 0, union))


def covered(inner: Column, outer: Column) -> Column:
    """The share of the inner box that lies in the outer one."""
    return overlap(inner, outer) / F.greatest(F.lit(MIN_AREA), area(inner))


def refinable(b: Column) -> Column:
    return ((b["x1"] - b["x0"]) > REFINE_WIDTH) & ((b["y1"] - b["y0"]) > REFINE_HEIGHT)


def portrait(b: Column) -> Column:
    """Null for a box without width or height, which has no say."""
    w, h = F.abs(b["x1"] - b["x0"]), F.abs(b["y1"] - b["y0"])
    return F.when((w > 0) & (h > 0), h > 1.5 * w)


def crop_rect(b: Column, width: Column, height: Column) -> Column:
    """The padded box in whole pixels, and whether anything is left of it."""
    px = lambda v, side: (clamp(v) * side).cast("int")
    x0, y0 = px(b["x0"] - CROP_PAD, width), px(b["y0"] - CROP_PAD, height)
    x1, y1 = px(b["x1"] + CROP_PAD, width), px(b["y1"] + CROP_PAD, height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x1 <= x0) | (y1 <= y0)).alias("blank"))


def crop_size(w: Column, h: Column) -> Column:
    """The size of a crop after small ones are enlarged."""
    scale = F.greatest(F.lit(float(CROP_SIDE)) / w, F.lit(float(CROP_SIDE)) / h)
    small = (w < CROP_SIDE) | (h < CROP_SIDE)
    side = lambda v: F.when(small, (v * scale).cast("int")).otherwise(v.cast("int"))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def thumbnail(w: Column, h: Column, most: int) -> Column:
    """The size with the longest edge at most `most`; never enlarged."""
    longest = F.greatest(w, h)
    side = lambda v: F.when(longest > most, F.greatest(F.lit(1), rounded(v * F.lit(float(most)) / longest))).otherwise(v.cast("int"))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def font_size(box_height: Column) -> Column:
    return F.greatest(F.lit(FONT_LEAST), F.least(F.lit(FONT_MOST), box_height / F.lit(ASCENDER - DESCENDER)))


def full_page(b: Column, text: Column) -> Column:
    near = (b["x0"] <= 0.001) & (b["y0"] <= 0.001) & (b["x1"] >= 0.999) & (b["y1"] >= 0.999)
    return near & F.contains(text, F.lit("\n"))


def match_cost(chars: Column, expected: Column) -> Column:
    """How badly a line of so many characters fills a box that expects so many; too much costs up to twice as much as too little."""
    e, a = F.greatest(F.lit(1.0), expected), F.greatest(F.lit(1.0), chars.cast("double"))
    return F.when(a > e, (a - e) / a).otherwise((e - a) / e * 0.5)
