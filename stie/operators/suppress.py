"""Greedy selection of boxes within a frame, as a fold over the frame's ordered boxes inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stie.functions import geometry as G


def box(b: Column) -> G.Box:
    return G.Box(b["x1"], b["y1"], b["x2"], b["y2"])


def greedy(objects: DataFrame, frame: list[str], order: list[Column], clash: Callable[[Column, Column], Column], most: int | None = None) -> DataFrame:
    """The objects that no object kept before them, by `order`, clashes with; `most` a frame at most. A frame's boxes are one row."""
    held = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*objects.columns).alias("b"))
    rows = objects.groupBy(*frame).agg(F.sort_array(F.collect_list(held)).alias("all")).select(*frame, F.transform("all", lambda x: x["b"]).alias("all"))

    def take(kept: Column, one: Column) -> Column:
        bad = F.exists(kept, lambda k: clash(k, one))
        if most is not None:
            bad = bad | (F.size(kept) >= most)
        return F.when(bad, kept).otherwise(F.concat(kept, F.array(one)))

    kept = F.aggregate("all", F.slice("all", 1, 0), take)
    return rows.select(F.explode(kept).alias("b")).select("b.*")


def suppress(objects: DataFrame, frame: list[str], threshold: float = 0.5, name: str = "obj") -> DataFrame:
    """Boxes by confidence; one that overlaps a kept box of its kind by `threshold` IoU goes. Several passes' boxes are united before."""
    return greedy(objects, frame, [-F.col("conf"), F.col(name)], lambda k, b: (k["kind"] == b["kind"]) & (G.iou(box(k), box(b)) >= threshold))


def drop_contained(objects: DataFrame, frame: list[str], share: float = 0.9, name: str = "obj") -> DataFrame:
    """The largest first; a box that lies in a kept one of its sort (person or not) by more than `share` of its own area goes."""
    same = lambda k, b: (k["kind"] == "person") == (b["kind"] == "person")
    return greedy(objects, frame, [-G.Box.of().area, F.col(name)], lambda k, b: same(k, b) & (G.intersection(box(k), box(b)) > share * F.greatest(box(b).area, F.lit(1e-6))))


def motion_crops(crops: DataFrame, frame: list[str], most: int = 4, overlap: float = 0.65, name: str = "obj") -> DataFrame:
    """The `most` crops with the most motion, then the greatest corners, of which no two overlap by more than that IoU."""
    order = [-F.col("motion"), *[-F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col(name)]
    return greedy(crops, frame, order, lambda k, b: G.iou(box(k), box(b)) > overlap, most)


def united(passes: list[DataFrame], frame: list[str], threshold: float = 0.5, name: str = "obj") -> DataFrame:
    """What several detection passes found in a frame, each thing once."""
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    return suppress(found, frame, threshold, name)
