"""The best vehicle of every person in a frame, without making all near pairs.

In a crowded frame a person is near a share of all vehicles, so near pairs grow with the square of the boxes. Who only asks
for the best one needn't see them: boxes are dealt by frame (very large frames by tiles of it), and in a task vehicles stand in small cells.
A cell's bounds say how good its best vehicle can be at most, and people look through cells, the most promising first,
until no other can hold a better one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.functions import geometry as G
from stie.operators.graph import components, reliable
from stie.operators.grid import CORNERS, SLACK, _in_cells

#: Boxes of one frame that a task looks at together, about.
TILE = 50_000
#: Fewer pairs than this are looked at all at once.
FEW = 20_000
IN_CELL = 24
#: Ranks are rounded to 9 digits, so what is closer than this may change places.
NEAR = 2e-9


@dataclass(frozen=True)
class Rule:
    """What makes a vehicle the best: the numbers of geometry.vehicle_rank, and the margin within which vehicles are near (none: all are)."""

    margin: float | None = 0.2
    center_weight: float = 0.2
    confidence_weight: float = 0.02
    body: bool = False
    body_aspect: float = 1.5
    body_confidence: float = 0.2
    body_anchor: float = 0.6
    body_margin: float = 0.08
    body_miss: float = 2.0
    plain: bool = False  # by the gap in pixels, which is not a share of anything

    def near(self, p: G.Box, v: G.Box) -> Column:
        return F.lit(True) if self.margin is None else G.near(p, v, self.margin)

    def rank(self, several: Column) -> Column:
        """The rank of a near pair, columns p_..., v_..."""
        if self.plain:
            return G.gap(G.Box.of("p_"), G.Box.of("v_"))
        rank = lambda ambiguous: G.vehicle_rank(
            G.Box.of("p_"), G.Box.of("v_"), F.col("p_conf"), F.col("v_conf"), F.lit(ambiguous), self.center_weight, self.confidence_weight, self.body, body_aspect=self.body_aspect,
            body_confidence=self.body_confidence, body_anchor=self.body_anchor, body_margin=self.body_margin, body_miss=self.body_miss,
        )
        return F.round(F.when(several, rank(True)).otherwise(rank(False)) if self.body else rank(False), 9)

    def ranks(self, p: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same of all people and vehicles as a matrix, of several vehicles each, and which are near."""
        p = {k: x[:, None] for k, x in p.items()}
        dx = np.maximum(np.maximum(p["x1"] - v["x2"], v["x1"] - p["x2"]), 0.0)
        dy = np.maximum(np.maximum(p["y1"] - v["y2"], v["y1"] - p["y2"]), 0.0)
        gap = np.sqrt(dx * dx + dy * dy)
        side = np.maximum(v["side"], G.SMALL)
        near = np.ones(gap.shape, dtype=bool) if self.margin is None else gap <= v["side"] * self.margin
        base = gap if self.plain else gap / side
        if self.center_weight:
            cx, cy = p["cx"] - v["cx"], p["cy"] - v["cy"]
            base = base + self.center_weight * (np.sqrt(cx * cx + cy * cy) / side)
        if self.confidence_weight:
            base = base - self.confidence_weight * v["conf"]
        if self.body:
            y = p["y1"] + self.body_anchor * (p["y2"] - p["y1"])
            m = self.body_margin * np.maximum(v["y2"] - v["y1"], 1.0)
            aside = np.maximum(np.maximum(v["x1"] - p["cx"], p["cx"] - v["x2"]), 0.0) / np.maximum(v["x2"] - v["x1"], 1.0)
            upright = ((p["y2"] - p["y1"]) / np.maximum(p["x2"] - p["x1"], G.SMALL) >= self.body_aspect) & (p["conf"] >= self.body_confidence)
            base = np.where(upright, np.where((y >= v["y1"] - m) & (y <= v["y2"] + m), 0.0, self.body_miss) + aside + 0.01 * base, base)
        # a rank that isn't known sorts first
        return np.where(np.isnan(base), -np.inf, base), near

    def bounds(self, p: dict[str, np.ndarray], cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The least rank that a vehicle of a cell can have for any of these people, and which cells may hold near ones."""
        apart = lambda lo, hi, low, high: np.maximum(np.maximum(lo - high, low - hi), 0.0)
        dx, dy = (apart(p[f"{a}1"].min(), p[f"{a}2"].max(), cells[f"{a}1"], cells[f"{a}2"]) for a in "xy")
        gap, side = np.sqrt(dx * dx + dy * dy), np.maximum(cells["side"], G.SMALL)
        cx, cy = (apart(p[f"c{a}"].min(), p[f"c{a}"].max(), cells[f"c{a}_low"], cells[f"c{a}_high"]) for a in "xy")
        base = (gap if self.plain else gap / side) + max(self.center_weight, 0.0) * np.sqrt(cx * cx + cy * cy) / side - max(self.confidence_weight, 0.0) * cells["conf"]
        if self.body:
            aside = apart(p["cx"].min(), p["cx"].max(), cells["x1"], cells["x2"]) / np.maximum(cells["width"], 1.0)
            base = np.minimum(base, aside + 0.01 * base)
        reach = np.ones(gap.shape, dtype=bool) if self.margin is None else gap <= cells["side"] * self.margin * (1 + 1e-9) + SLACK
        return np.where(np.isnan(base), -np.inf, base), reach


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: table.column(c).cast(pa.float64()).to_numpy() for c in [*CORNERS, "conf"]}
    out |= {"cx": (out["x1"] + out["x2"]) / 2, "cy": (out["y1"] + out["y2"]) / 2, "side": np.maximum(out["x2"] - out["x1"], out["y2"] - out["y1"])}
    return out


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the ids; text by its bytes."""
    values = ids.cast(pa.binary()).to_numpy(zero_copy_only=False) if pa.types.is_string(ids.type) else ids.to_numpy()
    return np.unique(values, return_inverse=True)[1]


def _cells(v: dict[str, np.ndarray], of: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of boxes by cells of about so many centers, and the bounds of the cells in it."""
    strips = max(1, int(np.sqrt(len(v["cx"]) / of)))
    strip = np.argsort(np.argsort(v["cx"], kind="stable"), kind="stable") * strips // len(v["cx"])
    order = np.lexsort((v["cy"], strip))
    bounds = np.flatnonzero(np.diff(strip[order], prepend=-1))
    return order, np.concatenate([*[np.arange(a, z, of) for a, z in zip(bounds, [*bounds[1:], len(order)], strict=True)], [len(order)]])


def best(p: dict[str, np.ndarray], v: dict[str, np.ndarray], place: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """People, vehicles and numbers of near vehicles (looked at until there are two): the best vehicle of each person, and any of nearly the same rank."""
    if len(p["cx"]) * len(v["cx"]) <= FEW:
        return _best_of([np.arange(len(v["cx"]))], p, v, place, rule)
    order, cut = _cells(v, IN_CELL)
    laid = {k: x[order] for k, x in v.items()}
    least, most = (lambda x: np.minimum.reduceat(x, cut[:-1])), (lambda x: np.maximum.reduceat(x, cut[:-1]))
    cells = {"x1": least(np.minimum(laid["x1"], laid["x2"])), "y1": least(np.minimum(laid["y1"], laid["y2"])), "x2": most(np.maximum(laid["x1"], laid["x2"])), "y2": most(np.maximum(laid["y1"], laid["y2"])), "side": most(laid["side"]), "conf": most(laid["conf"]), "width": most(laid["x2"] - laid["x1"])}
    cells |= {f"c{a}_{n}": f(laid[f"c{a}"]) for a in "xy" for n, f in (("low", least), ("high", most))}
    people, steps = _cells(p, IN_CELL)
    found = []
    for a, z in zip(steps[:-1], steps[1:], strict=True):
        some = people[a:z]
        group = {k: x[some] for k, x in p.items()}
        bound, reach = rule.bounds(group, cells)
        ahead = np.flatnonzero(reach)
        ahead = ahead[np.argsort(bound[ahead], kind="stable")]
        if len(ahead):
            parts = [order[cut[c] : cut[c + 1]] for c in ahead]
            i, j, n = _best_of(parts, group, v, place, rule, bound[ahead])
            found.append((some[i], j, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def _best_of(parts: list[np.ndarray], p: dict[str, np.ndarray], v: dict[str, np.ndarray], place: np.ndarray, rule: Rule, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    people = len(p["cx"])
    lead, near_ones, found, at, width = np.full(people, np.inf), np.zeros(people, dtype=np.int64), [], 0, 4
    while at < len(parts):
        if bound is not None and at and bound[at] > lead.max() + NEAR + 1e-12 and not (rule.body and (near_ones < 2).any()):
            break
        some = np.concatenate(parts[at : at + width])
        at, width = at + width, 2 * width
        some = some[np.argsort(place[some], kind="stable")]
        x, near = rule.ranks(p, {k: c[some] for k, c in v.items()})
        x = np.where(near, x, np.inf)
        near_ones += near.sum(axis=1)
        top = x.min(axis=1)
        first = x.argmin(axis=1)
        lead = np.minimum(lead, top)
        rows = np.flatnonzero((near.any(axis=1)) & (top <= lead + NEAR))
        found.append((rows, some[first[rows]], top[rows]))
        i, j = np.nonzero((x <= lead[:, None] + NEAR) & (x != top[:, None]) & near)
        found.append((i, some[j], x[i, j]))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    i, j, x = (np.concatenate(c) for c in zip(*found, strict=True))
    # one with few near vehicles has no rank of several yet, so all of them count
    keep = x <= lead[i] + NEAR
    return i[keep], j[keep], near_ones[i[keep]]


def best_pairs(people: DataFrame, vehicles: DataFrame, frame: list[str], rule: Rule, deal: list[str] | None = None) -> DataFrame:
    """The near pairs that hold each person's best vehicle of its frame, columns p_..., v_..., and p_several: whether it has several near ones.

    Both sides: frame, id, box, conf, and any others. Vehicles that nearly tie may come too, so who wants one takes the least
    by rule.rank and id. Boxes with null corners are near nothing. Without a margin, a frame is one tile.
    deal: columns of the result, p_id and some of the frame's, by which its rows are dealt for what comes next, so that they move once.
    """
    side = lambda df, name: df.dropna(subset=[*frame, *CORNERS]).withColumn("_side", F.lit(name))
    both = side(people, 0).unionByName(side(vehicles, 1), allowMissingColumns=True)
    if rule.margin is None:
        dealt = both.withColumn("_at", F.lit(0))
    else:
        by = W.partitionBy(*frame)
        extent = F.greatest(*[F.max(F.greatest(f"{a}1", f"{a}2")).over(by) - F.min(F.least(f"{a}1", f"{a}2")).over(by) for a in "xy"])
        n = F.count("*").over(by)
        laid = both.withColumns({"_left": F.min(F.least("x1", "x2")).over(by), "_top": F.min(F.least("y1", "y2")).over(by), "_cell": F.when(n > TILE, F.greatest(extent / F.ceil(F.sqrt(n / TILE)), F.lit(SLACK))).otherwise(float("inf"))})
        far = F.when(F.col("_side") == 1, F.greatest(G.Box.of().side * rule.margin, F.lit(0.0)) * (1 + 1e-9)).otherwise(0.0) + SLACK
        dealt = _in_cells(laid.withColumn("side_", F.col("_side")), far, "", frame).drop("_x", "_y").withColumnRenamed("side_", "_side")
    own = [c for c in people.columns if c not in frame]
    theirs = [c for c in vehicles.columns if c not in frame]
    out = dealt.select(*frame, *[F.col(c).alias(f"p_{c}") for c in own], *[F.col(c).alias(f"v_{c}") for c in theirs], F.lit(0).cast("long").alias("_near"))
    names = out.columns

    def of_tile(tile: pa.Table) -> pa.Table:
        flag = tile.column("_side").to_numpy()
        p, v = (tile.take(pa.array(np.flatnonzero(flag == k))) for k in (0, 1))
        i = j = n = np.zeros(0, dtype=np.int64)
        if len(p) and len(v):
            i, j, n = best(_arrays(p), _arrays(v), _places(v.column("id")), rule)
        left, right = p.take(pa.array(i)), v.take(pa.array(j))
        columns = [*[left.column(c) for c in frame], *[left.column(c) for c in own], *[right.column(c) for c in theirs], pa.array(n)]
        return pa.table(columns, names=names)

    found = dealt.groupBy(*frame, "_at").applyInArrow(of_tile, out.schema)
    found = found.repartition(*deal) if deal else found
    # a person at a tile's edge is in several tiles, with perhaps another vehicle in each
    by = W.partitionBy(*frame, "p_id")
    several = (F.max("_near").over(by) >= 2) | (F.min("v_id").over(by) != F.max("v_id").over(by))
    return found.withColumn("p_several", several).drop("_near")


@dataclass(frozen=True)
class Closest(Rule):
    """Who stands closest to a point, of the people near a vehicle: here, points with their vehicles look among people."""

    def ranks(self, p: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p = {k: x[:, None] for k, x in p.items()}
        dx = np.maximum(np.maximum(v["x1"] - p["x2"], p["x1"] - v["x2"]), 0.0)
        dy = np.maximum(np.maximum(v["y1"] - p["y2"], p["y1"] - v["y2"]), 0.0)
        near = (np.sqrt(dx * dx + dy * dy) <= p["side"] * self.margin) & (v["who"] != p["who"])
        ox, oy = v["cx"] - p["cx"], v["cy"] - p["cy"]
        off = ox * ox + oy * oy
        return np.where(np.isnan(off), -np.inf, off), near

    def bounds(self, p: dict[str, np.ndarray], cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        apart = lambda lo, hi, low, high: np.maximum(np.maximum(lo - high, low - hi), 0.0)
        cx, cy = (apart(p[f"c{a}"].min(), p[f"c{a}"].max(), cells[f"c{a}_low"], cells[f"c{a}_high"]) for a in "xy")
        dx, dy = (apart(np.minimum(p[f"{a}1"], p[f"{a}2"]).min(), np.maximum(p[f"{a}1"], p[f"{a}2"]).max(), cells[f"{a}1"], cells[f"{a}2"]) for a in "xy")
        reach = np.sqrt(dx * dx + dy * dy) <= max(p["side"].max() * self.margin, 0.0) * (1 + 1e-9) + SLACK
        off = cx * cx + cy * cy
        return np.where(np.isnan(off), -np.inf, off), reach


def closest_near(points: DataFrame, people: DataFrame, frame: list[str], margin: float) -> DataFrame:
    """points with o_id, ox, oy: the person whose center is closest to (px, py) of those near the point's box in its frame, but not `id`; null if nobody is.

    points: frame, id, px, py, box (of a vehicle), and others; those with a null box find nobody. people: frame, id, box. Nearly tied ones come too, a row each.
    A task holds one frame's points and people.
    """
    both = points.withColumn("_side", F.lit(0)).unionByName(people.dropna(subset=CORNERS).select(*frame, "id", *CORNERS, F.lit(1).alias("_side")), allowMissingColumns=True)
    out = points.select("*", F.lit(None).cast(people.schema["id"].dataType).alias("o_id"), F.lit(None).cast("double").alias("ox"), F.lit(None).cast("double").alias("oy"))
    names, rule = out.columns, Closest(margin)

    def of_frame(tile: pa.Table) -> pa.Table:
        flag = tile.column("_side").to_numpy()
        tile = tile.append_column("conf", pa.array(np.zeros(len(tile))))
        boxed = tile.column("x1").is_valid().to_numpy() & tile.column("y1").is_valid().to_numpy() & tile.column("x2").is_valid().to_numpy() & tile.column("y2").is_valid().to_numpy()
        who = _places(tile.column("id"))
        asks, others = np.flatnonzero((flag == 0) & boxed), np.flatnonzero(flag == 1)
        i = j = np.zeros(0, dtype=np.int64)
        p, v = _arrays(tile.take(pa.array(asks))), _arrays(tile.take(pa.array(others)))
        v["who"] = who[others]
        if len(asks) and len(others):
            at = tile.take(pa.array(asks))
            p |= {"cx": at.column("px").to_numpy(), "cy": at.column("py").to_numpy(), "who": who[asks]}
            i, j, _ = best(p, v, v["who"], rule)
        none = np.setdiff1d(np.flatnonzero(flag == 0), asks[i])
        rows = tile.take(pa.array(np.concatenate([asks[i], none])))
        found = lambda x, kind: pa.concat_arrays([x, pa.nulls(len(none), kind)])
        ids = tile.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        more = [found(ids.take(pa.array(others[j])), ids.type), found(pa.array(v["cx"][j], pa.float64()), pa.float64()), found(pa.array(v["cy"][j], pa.float64()), pa.float64())]
        return pa.table([*[rows.column(c) for c in names[:-3]], *more], names=names)

    return both.groupBy(*frame).applyInArrow(of_frame, out.schema)


def largest_beside(people: DataFrame, vehicles: DataFrame, frame: list[str], pixels: float, width: float, height: float) -> DataFrame:
    """people with v_id and the vehicle's box, v_x1 ... v_y2: the vehicle with the greatest area of those that a person overlaps or stands beside; then that with the greater overlap, then the least id.

    Beside is within `pixels`, or that share of the vehicle's width, aside, and at its level for that share of the lower height. Both: frame, id,
    box; people may have more columns. Vehicles are looked through from the largest one on, so who stands beside many stops early. A task holds one frame.
    """
    both = people.dropna(subset=CORNERS).withColumn("_side", F.lit(0)).unionByName(vehicles.dropna(subset=CORNERS).select(*frame, "id", *CORNERS, F.lit(1).alias("_side")), allowMissingColumns=True)
    out = people.select("*", F.lit(None).cast(vehicles.schema["id"].dataType).alias("v_id"), *[F.lit(None).cast("double").alias(f"v_{c}") for c in CORNERS])
    names, own = out.columns, people.columns

    def of_frame(tile: pa.Table) -> pa.Table:
        flag = tile.column("_side").to_numpy()
        left, right = (tile.take(pa.array(np.flatnonzero(flag == k))) for k in (0, 1))
        boxes = lambda t: {c: t.column(c).cast(pa.float64()).to_numpy() for c in CORNERS}
        p, v = boxes(left), boxes(right)
        chosen = np.full(len(left), -1)
        if len(left) and len(right):
            area = np.maximum(v["x2"] - v["x1"], 0.0) * np.maximum(v["y2"] - v["y1"], 0.0)
            order = np.lexsort((_places(right.column("id")), -np.where(np.isnan(area), np.inf, area)))
            v, area = {c: x[order] for c, x in v.items()}, area[order]
            open_, most, reached, at, step = np.arange(len(left)), np.full(len(left), -np.inf), np.full(len(left), -1.0), 0, 32
            while at < len(order) and len(open_):
                some = slice(at, at + max(1, min(step, 2_000_000 // len(open_))))
                q, w = {c: x[open_, None] for c, x in p.items()}, {c: x[some] for c, x in v.items()}
                aside = np.maximum(np.maximum(w["x1"] - q["x2"], q["x1"] - w["x2"]), 0.0)
                level = np.maximum(np.minimum(q["y2"], w["y2"]) - np.maximum(q["y1"], w["y1"]), 0.0)
                shared = np.maximum(np.minimum(q["x2"], w["x2"]) - np.maximum(q["x1"], w["x1"]), 0.0) * level
                ok = (shared > 0) | ((aside <= np.maximum(pixels, width * np.maximum(w["x2"] - w["x1"], 1.0))) & (level >= height * np.minimum(q["y2"] - q["y1"], w["y2"] - w["y1"])))
                # of the first area that holds one beside, here or in the steps before, the greatest overlap counts
                first = np.where(ok.any(axis=1), area[some][ok.argmax(axis=1)], -1.0)
                reached[open_] = np.where(reached[open_] < 0, first, reached[open_])
                value = np.where(ok & (area[some] == reached[open_, None]), shared, -np.inf)
                top = value.max(axis=1)
                better = top > most[open_]
                chosen[open_[better]] = order[at + value.argmax(axis=1)[better]]
                most[open_] = np.maximum(most[open_], top)
                at, step = some.stop, 2 * step
                if at < len(order):
                    open_ = open_[(reached[open_] < 0) | (area[at] == reached[open_])]
        hit = np.flatnonzero(chosen >= 0)
        found, theirs = left.take(pa.array(hit)), right.take(pa.array(chosen[hit]))
        return pa.table([*[found.column(c) for c in own], theirs.column("id"), *[theirs.column(c).cast(pa.float64()) for c in CORNERS]], names=names)

    return both.groupBy(*frame).applyInArrow(of_frame, out.schema)


def _nested(v: dict[str, np.ndarray], share: float, a: np.ndarray, b: slice | np.ndarray) -> np.ndarray:
    """Of boxes a (rows) and b, which lie in each other by that share of the smaller one."""
    shared = np.maximum(np.minimum(v["x2"][a, None], v["x2"][b]) - np.maximum(v["x1"][a, None], v["x1"][b]), 0.0) * np.maximum(np.minimum(v["y2"][a, None], v["y2"][b]) - np.maximum(v["y1"][a, None], v["y1"][b]), 0.0)
    return shared / np.maximum(np.minimum(v["area"][a, None], v["area"][b]), G.SMALL) >= share


def _first_nested(v: dict[str, np.ndarray], root: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Each box with the first one of a lesser root that it lies in or that lies in it, looking from the least root on until there is one."""
    order = np.argsort(root, kind="stable")
    v, root = {c: x[order] for c, x in v.items()}, root[order]
    left, right, open_, at, step = [], [], np.arange(len(root)), 0, 32
    while at < len(root):
        open_ = open_[root[open_] > root[at]]
        if not len(open_):
            break
        end = min(len(root), at + max(1, min(step, 2_000_000 // len(open_))))
        ok = _nested(v, share, open_, slice(at, end)) & (root[open_, None] > root[at:end])
        hit = ok.any(axis=1)
        left.append(order[open_[hit]])
        right.append(order[at + ok.argmax(axis=1)[hit]])
        open_, at, step = open_[~hit], end, 2 * step
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (left, right))


def _all_nested(v: dict[str, np.ndarray], root: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """All such pairs of different roots. Cells that are apart, or hold one root both, aren't looked at."""
    order, cut = _cells(v, IN_CELL)
    v, root = {c: x[order] for c, x in v.items()}, root[order]
    least, most = (lambda x: np.minimum.reduceat(x, cut[:-1])), (lambda x: np.maximum.reduceat(x, cut[:-1]))
    x1, y1, x2, y2, low, high = least(v["x1"]), least(v["y1"]), most(v["x2"]), most(v["y2"]), least(root), most(root)
    left, right = [], []
    for c in range(len(cut) - 1):
        others = np.arange(c, len(cut) - 1)
        meets = (x1[others] <= x2[c]) & (x1[c] <= x2[others]) & (y1[others] <= y2[c]) & (y1[c] <= y2[others])
        others = others[meets & ~((low[c] == high[c]) & (low[others] == low[c]) & (high[others] == low[c]))]
        if len(others):
            a, b = np.arange(cut[c], cut[c + 1]), np.concatenate([np.arange(cut[o], cut[o + 1]) for o in others])
            i, j = np.nonzero(_nested(v, share, a, b) & (root[a, None] != root[b]) & (a[:, None] < b))
            left.append(order[a[i]])
            right.append(order[b[j]])
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (left, right))


def _named(find: Callable, key: str, share: float) -> Callable[[pa.Table], pa.Table]:
    """find() on one frame's boxes, as a table of pairs of ids."""

    def of_frame(tile: pa.Table) -> pa.Table:
        v = {c: tile.column(c).cast(pa.float64()).to_numpy() for c in CORNERS}
        v |= {"cx": (v["x1"] + v["x2"]) / 2, "cy": (v["y1"] + v["y2"]) / 2, "area": np.maximum(v["x2"] - v["x1"], 0.0) * np.maximum(v["y2"] - v["y1"], 0.0)}
        i, j = find(v, _places(tile.column("root")), share)
        a, b = (tile.take(pa.array(x)) for x in (i, j))
        return pa.table([a.column(key), a.column("id"), b.column("id")], names=[key, "a", "b"])

    return of_frame


#: How often groups of nested boxes grow by single links before all links between groups are made.
GROWTHS = 3


def nested_components(boxes: DataFrame, key: str, frame: str, share: float, frames: int) -> DataFrame:
    """key, node, root: ids whose boxes lie in each other, by that share of the smaller one, in so many frames, and all that hang together through such; the least id is the root.

    Pairs inside a component say nothing new, so they aren't made: first each box names one box of another component only, a few times, and links that hold in
    enough frames join components; then all pairs of boxes between the components that are left are made, so none is missed. Needs share > 0. A task holds one frame.
    """
    cut = boxes.dropna(subset=[key, frame, "id", *CORNERS]).select(key, frame, "id", *CORNERS)
    kind = cut.schema["id"].dataType.simpleString()
    result = f"{key} {cut.schema[key].dataType.simpleString()}, a {kind}, b {kind}"
    links, roots, turn = None, None, 0
    while turn <= GROWTHS:
        find = _all_nested if turn == GROWTHS else _first_nested
        told = cut.withColumn("root", F.col("id")) if roots is None else cut.join(roots.select(key, F.col("node").alias("id"), "root"), [key, "id"], "left").withColumn("root", F.coalesce("root", "id"))
        met = told.groupBy(key, frame).applyInArrow(_named(find, key, share), result).where("a <> b")
        pairs = met.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy(key, "a", "b").count().where(F.col("count") >= frames)
        fresh = reliable(pairs.select(key, "a", "b"))
        none = fresh.isEmpty()
        if not none or links is None:
            links = fresh if links is None else links.unionByName(fresh)
            roots = reliable(components(links, [key]))
        turn = GROWTHS if none and turn < GROWTHS else turn + 1
    return roots
