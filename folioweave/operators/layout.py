"""Reading order of boxes on pages by recursive XY-cut.

A page's boxes are cut where no box lies: at the widest gap, between rows into an upper and a lower part, between columns into a
left and a right one, and each part again until nothing separates what is left. What is left is read from top to
bottom, then from left to right. Headings over two columns thus come first, then one column after the other, where plain
sorting by height would mix the columns' lines.

Pages are groups of bounded size, each within the row of its document, and documents are dealt over tasks; a page's boxes are sorted once for
each cut, at most as often as it has boxes.

Cases: a null array stays null and an empty one empty; boxes without a page are one page, before all others; a box without
coordinates, or with some that aren't finite, comes behind the others of its page, in the order given; corners may be in any
order; boxes that overlap aren't separated; equal boxes stay in the order given.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Box = tuple[float, float, float, float]

#: Columns, of the elements of an array, that say where a box lies.
PAGE, CORNERS = "page_number", ("x0", "y0", "x1", "y1")


def _gap(boxes: Sequence[Box], which: Sequence[int], axis: int, least: float) -> tuple[float, float] | None:
    """The widest gap between boxes along an axis, at least ``least`` wide, and where it begins; the first of equal ones."""
    best, reach = None, None
    for low, high in sorted((boxes[k][axis], boxes[k][axis + 2]) for k in which):
        if reach is not None and low - reach >= least and low > reach and (best is None or low - reach > best[0]):
            best = (low - reach, reach)
        reach = high if reach is None else max(reach, high)
    return best


def xy_cut(boxes: Sequence[Box], least: float = 0.0) -> list[int]:
    """The order of reading, as places in ``boxes`` (left, top, right, bottom)."""
    out: list[int] = []
    parts = [list(range(len(boxes)))]
    while parts:
        which = parts.pop()
        rows, columns = (_gap(boxes, which, axis, least) for axis in (1, 0))
        # of equally wide gaps the one between rows
        if rows is None and columns is None:
            out += sorted(which, key=lambda k: (boxes[k][1], boxes[k][0]))
            continue
        axis, cut = (1, rows[1]) if columns is None or (rows is not None and rows[0] >= columns[0]) else (0, columns[1])
        parts.append([k for k in which if boxes[k][axis] > cut])
        parts.append([k for k in which if boxes[k][axis] <= cut])
    return out


def _order(elements: list[dict], page: str, corners: Sequence[str], least: float) -> list[int]:
    pages: dict[object, list[int]] = {}
    for k, e in enumerate(elements):
        pages.setdefault(None if e is None else e[page], []).append(k)
    out: list[int] = []
    for p in sorted(pages, key=lambda p: (p is not None, p)):
        boxes, known, rest = [], [], []
        for k in pages[p]:
            x0, y0, x1, y1 = (None if elements[k] is None else elements[k][c] for c in corners)
            if any(v is None or not math.isfinite(v) for v in (x0, y0, x1, y1)):
                rest.append(k)
            else:
                boxes.append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
                known.append(k)
        out += [known[k] for k in xy_cut(boxes, least)] + rest
    return out


def in_reading_order(docs: DataFrame, elements: str, into: str | None = None, *, page: str = PAGE, corners: Sequence[str] = CORNERS, least: float = 0.0) -> DataFrame:
    """``docs`` with the array of structs ``elements`` in reading order; only boxes and places go to Python and back."""
    boxes = F.transform(elements, lambda e: F.struct(e[page].alias("page"), *(e[c].cast("double").alias(c) for c in corners)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(rows):
        return rows.map(lambda own: None if own is None else _order(list(own), "page", corners, least))

    found = docs.withColumn("_order", order(boxes))
    return found.withColumn(into or elements, F.transform("_order", lambda k: F.get(F.col(elements), k))).drop("_order")
