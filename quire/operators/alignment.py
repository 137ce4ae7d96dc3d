"""Alignment of text lines to boxes: the cheapest monotone matching, in two reading orders.

The dynamic programme runs once for each page in an Arrow batch: its cells depend on each other one by one, and pages
are independent. Everything around it is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values
SKIP_LINE, SKIP_BOX = 1.0, 0.4
MIN_AREA = 1e-6
MANY_BOXES = 5

MATCH, LINE, BOX = 0, 1, 2


def expected_chars(areas: list[float], chars: int) -> list[float]:
    total = 0.0
    for a in areas:
        total += a
    return [a / total * chars for a in areas]


def steps_of(lengths: list[int], wanted: list[float]) -> tuple[float, list[bytes]]:
    """The programme's cost, and how each of its cells is reached, cell by cell."""
    row = [0.0]
    for _ in wanted:
        row.append(row[-1] + SKIP_BOX)
    steps = []
    for length in lengths:
        a = max(1, length)
        new, step = [row[0] + SKIP_LINE], bytearray([LINE])
        for j, e in enumerate(wanted):
            best, how = row[j] + ((a - e) / a if a > e else (e - a) / e * 0.5), MATCH
            if (up := row[j + 1] + SKIP_LINE) < best:
                best, how = up, LINE
            if (left := new[j] + SKIP_BOX) < best:
                best, how = left, BOX
            new.append(best)
            step.append(how)
        steps.append(bytes(step))
        row = new
    return row[-1], steps


def steps_by_diagonals(lengths: list[int], wanted: list[float]) -> tuple[float, np.ndarray]:
    """The same for large pages: cells of a diagonal don't depend on each other, and get the same operations."""
    n, m = len(lengths), len(wanted)
    a, e = np.maximum(np.array(lengths, float), 1.0), np.array(wanted)
    # the first row and column are sums of steps, as in steps_of
    top, side = np.cumsum([0.0] + [SKIP_BOX] * m), np.cumsum([0.0] + [SKIP_LINE] * n)
    how = np.full((n, m + 1), LINE, np.uint8)
    before, now = np.zeros(n + 1), np.zeros(n + 1)  # diagonals, by line
    now[0] = 0.0
    for d in range(1, n + m + 1):
        after = np.empty(n + 1)
        if d <= m:
            after[0] = top[d]
        if d <= n:
            after[d] = side[d]
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            x, y = a[i - 1], e[d - i - 1]
            best = before[i - 1] + np.where(x > y, (x - y) / x, (y - x) / y * 0.5)
            step = np.full(len(i), MATCH, np.uint8)
            for other, kind in ((now[i - 1] + SKIP_LINE, LINE), (now[i] + SKIP_BOX, BOX)):
                less = other < best
                best, step[less] = np.where(less, other, best), kind
            after[i] = best
            how[i - 1, d - i] = step
        before, now = now, after
    return float(now[n]), how


#: Cells from which diagonals are faster.
LARGE = 10_000


def align(lengths: list[int], areas: list[float]) -> tuple[float, list[tuple[int, int]], int]:
    """(cost, (line, box it goes to) in order, matches). Equal costs prefer a match, then a skipped line.

    A skipped line goes to the box matched last, or to the first box if there is none.
    """
    wanted = [max(1.0, e) for e in expected_chars(areas, max(1, sum(lengths)))]
    cost, steps = (steps_by_diagonals if len(lengths) * len(areas) >= LARGE else steps_of)(lengths, wanted)
    i, j, back = len(lengths), len(areas), []
    while i:
        how = steps[i - 1][j]
        if how == BOX:
            j -= 1
            continue
        i -= 1
        j -= how == MATCH
        back.append((i, j if how == MATCH else None))
    out, last, matches = [], 0, 0
    for line, box in reversed(back):
        if box is not None:
            last, matches = box, matches + 1
        out.append((line, last))
    return cost, out, matches


PAGE = "n_lines int, n_boxes int, cost_rows double, cost_columns double, chosen string, matches int, whole boolean, assigned array<struct<line_idx:int,box_idx:int>>, boxes array<int>"


def aligned_pages(pages: DataFrame) -> DataFrame:
    """One row for each of `pages` (doc_id, lengths, areas, by_row, by_column): the costs of both orders and the cheaper one's assignment.

    by_row and by_column list the boxes' indexes in each order; the first order wins ties. `whole` tells that the page
    is better taken as one: no line matched although there are several, or one line stands against many boxes.
    doc_id may be of any type.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("line_idx", pa.int32()), ("box_idx", pa.int32())])), pa.list_(pa.int32())]
        names = ["doc_id", "n_lines", "n_boxes", "cost_rows", "cost_columns", "chosen", "matches", "whole", "assigned", "boxes"]
        for batch in it:
            rows = []
            for r in batch.select(["lengths", "areas", "by_row", "by_column"]).to_pylist():
                n, m = len(r["lengths"]), len(r["areas"])
                if not n or not m:
                    rows.append((n, m, 0.0, 0.0, "rows", 0, False, [], r["by_row"]))
                    continue
                tried = [(align(r["lengths"], [r["areas"][i] for i in order]), name, order) for name, order in (("rows", r["by_row"]), ("columns", r["by_column"]))]
                (_, found, matches), name, order = tried[1] if tried[1][0][0] < tried[0][0][0] else tried[0]
                whole = (matches == 0 and n > 1) or (n == 1 and m >= MANY_BOXES)
                rows.append((n, m, tried[0][0][0], tried[1][0][0], name, matches, whole, [{"line_idx": i, "box_idx": order[j]} for i, j in found], r["by_row"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds))], names)

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "lengths", "areas", "by_row", "by_column").mapInArrow(each, f"doc_id {kind}, {PAGE}")


def aligned_text(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, box_idx, text): each box with the lines that go to it, blank if none; box_idx -1 stands for a whole page.

    `pages` comes from aligned_pages and passes by once. Pages with lines but no box, and those flagged whole, become
    one row with all lines; boxes of pages without lines stay blank.
    """
    no_line = F.lit(None).cast("int").alias("line_idx")
    blank = F.transform("boxes", lambda b: F.struct(no_line, b.alias("box_idx")))
    to_all = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_lines"), F.lit(1)) - 1), lambda i: F.struct(i.alias("line_idx"), F.lit(-1).alias("box_idx")))
    alone = F.col("whole") | ((F.col("n_boxes") == 0) & (F.col("n_lines") > 0))
    to = pages.select("doc_id", F.inline(F.when(alone, to_all).otherwise(F.concat("assigned", blank))))
    told = to.join(lines, ["doc_id", "line_idx"], "left").groupBy("doc_id", "box_idx")
    found = told.agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_idx", "text")))).alias("said"))
    texts = F.transform("said", lambda x: x["text"])
    return found.select("doc_id", "box_idx", F.when(F.col("box_idx") < 0, F.array_join(texts, "\n")).otherwise(F.array_join(texts, " ")).alias("text"))
