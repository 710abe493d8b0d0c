"""Boxes of one frame that come near each other, without making all pairs of a frame.

A grid lies over the boxes of a crowded frame. A box stands in every cell that it touches, that
of the right side widened by its reach, and boxes meet by frame and cell. Two boxes can share several cells; they count in
that where the later of their lower corners lies. So a frame spreads over many tasks, and a box meets only what is around it.

The cells of a frame are as wide as the boxes of the right side with their reach are on average, so that most of these touch
four. There are at most SIDE cells each way: those at the edge hold what lies further out. Frames of few pairs are one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDE = 64
#: Frames with more pairs than this get a grid.
FEW = 64
#: Rounding must not part boxes that just touch.
SLACK = 1e-6
CORNERS = ["x1", "y1", "x2", "y2"]
HELPERS = ["_x", "_y"]


def _index(at: Column, origin: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor((at - F.col(origin)) / F.col("_cell")))).cast("int")


def _in_cells(boxes: DataFrame, reach: Column, prefix: str, frame: list[str]) -> DataFrame:
    """The boxes with prefixed columns, once for every cell, with the cell of their lower corner."""
    low = [F.least(f"{a}1", f"{a}2") - reach for a in "xy"]
    high = [F.greatest(f"{a}1", f"{a}2") + reach for a in "xy"]
    at = boxes.withColumns({"_x": _index(low[0], "_left"), "_y": _index(low[1], "_top"), "_x_end": _index(high[0], "_left"), "_y_end": _index(high[1], "_top")})
    cells = F.flatten(F.transform(F.sequence("_x", "_x_end"), lambda x: F.transform(F.sequence("_y", "_y_end"), lambda y: x * SIDE + y)))
    own = [c for c in boxes.columns if c not in frame and not c.startswith("_")]
    return at.select(*frame, F.explode(cells).alias("_at"), *[F.col(c).alias(prefix + c) for c in [*own, *HELPERS]])


def meeting(objects: DataFrame, frame: list[str], left: Column, right: Column, reach: Column, near: Column, names: tuple[str, str] = ("p_", "v_"), left_reach: Column | float = 0.0) -> DataFrame:
    """Pairs of a box of the left side and one of the right side of the same frame, of which `near` holds.

    left, right: which objects are on which side (one may be on both). reach: how far from a right one's box a left one's may lie, at
    most, for `near` to hold; left_reach: the same the other way round, if it is further. near looks at the prefixed columns. Boxes with null corners are near nothing.
    """
    far = F.greatest(reach, F.lit(0.0)) * (1 + 1e-9) + SLACK
    by = W.partitionBy(*frame)
    wide = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) + 2 * far
    extent = F.greatest(*[F.max(F.greatest(f"{a}1", f"{a}2")).over(by) - F.min(F.least(f"{a}1", f"{a}2")).over(by) for a in "xy"])
    crowded = F.count_if(left).over(by) * F.count_if(right).over(by) > FEW
    laid = objects.where(left | right).dropna(subset=CORNERS).withColumns(
        {
            "_left": F.min(F.least("x1", "x2")).over(by), "_top": F.min(F.least("y1", "y2")).over(by),
            "_cell": F.when(crowded, F.greatest(F.avg(F.when(right, wide)).over(by), extent / SIDE, F.lit(SLACK))).otherwise(float("inf")),
        }
    )
    a, b = _in_cells(laid.where(left), left_reach * F.lit(1 + 1e-9) + SLACK, names[0], frame), _in_cells(laid.where(right), far, names[1], frame)
    here = F.col("_at") == F.greatest(f"{names[0]}_x", f"{names[1]}_x") * SIDE + F.greatest(f"{names[0]}_y", f"{names[1]}_y")
    # the left side of a task is what its cells hold, so it can stand in memory; sorting both sides would cost more than the pairs
    return a.hint("shuffle_hash").join(b, [*frame, "_at"]).where(here & near).drop("_at", *[n + h for n in names for h in HELPERS])
