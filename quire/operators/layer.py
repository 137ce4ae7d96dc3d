"""Geometry of the invisible text layer: where each piece of text is drawn, at what size and width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

#: Heights halve at least with each split and start at 1 at most.
LEVELS = 3


def line_slices(boxes: DataFrame) -> DataFrame:
    """Boxes of several lines cut into equal slices, one a line; slice_idx counts them. Full pages with lines stay whole."""
    many = X.lines(F.col("text"))
    whole = G.full_page(F.col("box"), F.col("text"))
    parts = F.when(whole | (F.size(many) == 0), F.array(X.strip(F.col("text")))).otherwise(many)
    cut = boxes.withColumn("full_page", whole).withColumn("parts", parts).withColumn("n", F.size("parts"))
    cut = cut.select(*[c for c in cut.columns if c not in ("text", "parts")], F.posexplode("parts").alias("slice_idx", "text"))
    b = F.col("box")
    tall = (b["y1"] - b["y0"]) / F.col("n")
    sliced = G.box(b["x0"], b["y0"] + F.col("slice_idx") * tall, b["x1"], b["y0"] + (F.col("slice_idx") + 1) * tall)
    return cut.withColumn("box", F.when(F.col("n") > 1, sliced).otherwise(b)).drop("n").where("text <> ''")


def pieces_of(b: Column, words: Column, width: float | Column, height: float | Column) -> Column:
    """Into how many lines a tall box is cut: two, three if very tall, no more than it has words; one if it isn't tall."""
    tall = b["y1"] - b["y0"]
    aspect = (b["y1"] * height - b["y0"] * height) / F.greatest(F.lit(0.01), b["x1"] * width - b["x0"] * width)
    n = F.least(F.when(tall > G.VERY_TALL, 3).otherwise(2), F.size(words))
    return F.when((tall > G.TALL) & (aspect > G.TALL_ASPECT) & (F.size(words) >= 2), n).otherwise(1)


def tall_slices(boxes: DataFrame, width: float | Column = G.PAGE_WIDTH, height: float | Column = G.PAGE_HEIGHT) -> DataFrame:
    """Tall boxes cut into lines of words, again as long as the pieces are tall; `path` orders the pieces. Full pages stay.

    Words are split once; the pieces are slices of them.
    """
    words = F.filter(F.split(X.strip(F.col("text")), f"{X.SPACE}+"), lambda w: w != "")
    now = boxes.withColumn("path", F.lit("")).withColumn("w", words).withColumn("whole", F.lit(True))
    for _ in range(LEVELS):
        n = F.when(F.col("full_page"), 1).otherwise(pieces_of(F.col("box"), F.col("w"), width, height))
        held = now.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        b = F.col("box")
        tall = (b["y1"] - b["y0"]) / F.col("n")
        start = F.bround(F.col("k") * F.size("w") / F.col("n")).cast("int")
        end = F.bround((F.col("k") + 1) * F.size("w") / F.col("n")).cast("int")
        cut = F.col("n") > 1
        sliced = G.box(b["x0"], b["y0"] + F.col("k") * tall, b["x1"], b["y0"] + (F.col("k") + 1) * tall)
        now = held.withColumns({
            "box": F.when(cut, sliced).otherwise(b), "w": F.when(cut, F.slice("w", start + 1, end - start)).otherwise(F.col("w")),
            "whole": F.col("whole") & ~cut, "path": F.concat("path", F.col("k").cast("string")),
        }).drop("n", "k")
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.array_join("w", " "))
    return now.withColumn("text", text).select(*boxes.columns, "path").where("text <> ''")


def page_lines(boxes: DataFrame) -> DataFrame:
    """Full pages as one row for each of their lines; `line` counts them, and is 0 elsewhere."""
    lines = F.when(F.col("full_page"), X.lines(F.col("text"))).otherwise(F.array("text"))
    cut = boxes.withColumn("lines", lines)
    return cut.select(*[c for c in boxes.columns if c != "text"], F.posexplode("lines").alias("line", "text")).select(*boxes.columns, "line")


def drawn(pieces: DataFrame, width: float | Column = G.PAGE_WIDTH, height: float | Column = G.PAGE_HEIGHT) -> DataFrame:
    """`pieces` with x, baseline_y, font_size and target_width in points; boxes without area are gone.

    The lines of a full page stand below each other from its top, small and as wide as they are: their target is the
    page between its margins, which scaled_to takes for a limit. Elsewhere the horizontal scale is target_width over the
    text's natural width, which only a font knows.
    """
    pieces = page_lines(pieces)
    b = G.scaled(F.col("box"), F.lit(width), F.lit(height))
    held = pieces.withColumn("pt", b).where("pt.x1 - pt.x0 > 0 and pt.y1 - pt.y0 > 0")
    page, inset, font = F.col("full_page"), F.lit(G.TEXTBOX_INSET), F.lit(G.TEXTBOX_FONT)
    size = F.when(page, font).otherwise(G.font_size(F.col("pt.y1") - F.col("pt.y0")))
    x = F.when(page, inset).otherwise(F.col("pt.x0"))
    wide = F.col("pt.x1") - F.col("pt.x0")
    target = F.greatest(F.lit(1.0), F.when(page, wide - 2 * inset).otherwise(wide * G.FILL))
    from_top = inset + G.ASCENDER * font + F.col("line") * (G.ASCENDER - G.DESCENDER) * font
    below = F.when(page, from_top).otherwise(F.col("pt.y1") + F.lit(G.DESCENDER) * F.col("font_size"))
    return held.withColumn("font_size", size).select(*pieces.columns, x.alias("x"), below.alias("baseline_y"), "font_size", target.alias("target_width"))


def scaled_to(spans: DataFrame, natural_width: Column) -> DataFrame:
    """`spans` with scale_x, given each text's natural width at its font size; texts without width are gone."""
    scale = F.col("target_width") / F.col("natural")
    scale = F.when(F.col("full_page"), F.least(F.lit(1.0), scale)).otherwise(scale)
    return spans.withColumn("natural", natural_width).where("natural > 0").withColumn("scale_x", scale).drop("natural")
