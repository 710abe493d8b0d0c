"""Box and interval expressions on columns; a box is a Box of four columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-6


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def side(self) -> Column:
        return F.greatest(self.width, self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    @property
    def aspect(self) -> Column:
        """Height to width."""
        return self.height / F.greatest(self.width, F.lit(SMALL))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return both / F.greatest(a.area + b.area - both, F.lit(SMALL))


def containment(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.greatest(F.least(a.area, b.area), F.lit(SMALL))


def gap(a: Box, b: Box) -> Column:
    """Euclidean distance between the boxes, 0 if they overlap."""
    dx = F.greatest(a.x1 - b.x2, b.x1 - a.x2, F.lit(0.0))
    dy = F.greatest(a.y1 - b.y2, b.y1 - a.y2, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def normalized_gap(person: Box, vehicle: Box) -> Column:
    return gap(person, vehicle) / F.greatest(vehicle.side, F.lit(SMALL))


def center_distance(person: Box, vehicle: Box) -> Column:
    (px, py), (vx, vy) = person.center, vehicle.center
    return F.sqrt((px - vx) * (px - vx) + (py - vy) * (py - vy)) / F.greatest(vehicle.side, F.lit(SMALL))


def contains(box: Box, x: Column, y: Column, margin: float = 0.0) -> Column:
    """Whether the point is in the box widened by a share of its sides, edges included."""
    return x.between(box.x1 - box.width * margin, box.x2 + box.width * margin) & y.between(box.y1 - box.height * margin, box.y2 + box.height * margin)


def near(person: Box, vehicle: Box, margin: float) -> Column:
    return gap(person, vehicle) <= vehicle.side * margin


def near_with_head(person: Box, vehicle: Box, head: Box, margin: float, head_widths: float) -> Column:
    """Proximity in head widths where there is a head box, else by the vehicle's side."""
    return F.when(head.x1.isNotNull(), gap(person, vehicle) / F.greatest(head.width, F.lit(SMALL)) <= head_widths).otherwise(near(person, vehicle, margin))


def near_expanded(box: Box, vehicle: Box, share: float = 0.15) -> Column:
    """Whether the box touches the vehicle widened on both axes by a share of its longer side."""
    m = vehicle.side * share
    return (box.x2 >= vehicle.x1 - m) & (box.x1 <= vehicle.x2 + m) & (box.y2 >= vehicle.y1 - m) & (box.y1 <= vehicle.y2 + m)


def vehicle_rank(person: Box, vehicle: Box, person_conf: Column, vehicle_conf: Column, ambiguous: Column, center_weight: float = 0.2, confidence_weight: float = 0.02, body: bool = False, body_aspect: float = 1.5, body_confidence: float = 0.2, body_anchor: float = 0.6, body_margin: float = 0.08, body_miss: float = 2.0) -> Column:
    """Lower is better. `body`: among several vehicles, an upright person prefers one at the depth of the body."""
    base = normalized_gap(person, vehicle) + center_weight * center_distance(person, vehicle) - confidence_weight * vehicle_conf
    if not body:
        return base
    y = person.y1 + body_anchor * person.height
    margin = body_margin * F.greatest(vehicle.height, F.lit(1.0))
    crosses = y.between(vehicle.y1 - margin, vehicle.y2 + margin)
    x = person.center[0]
    aside = F.greatest(vehicle.x1 - x, x - vehicle.x2, F.lit(0.0)) / F.greatest(vehicle.width, F.lit(1.0))
    upright = ambiguous & (person.aspect >= body_aspect) & (person_conf >= body_confidence)
    return F.when(upright, F.when(crosses, 0.0).otherwise(body_miss) + aside + 0.01 * base).otherwise(base)


def longitudinal(person: Box, vehicle: Box) -> Column:
    """Where the person's center stands along the vehicle, 0 to 1."""
    return (person.center[0] - vehicle.x1) / F.greatest(vehicle.width, F.lit(SMALL))


def body_from_head(head: Box, frame_width: float, frame_height: float, widths: float = 3.2, heights: float = 6.5, above: float = 0.2) -> Box:
    """A body box that begins a little above a head box, within the frame."""
    x = head.center[0]
    wide, high = F.greatest(head.width, F.lit(1.0)), F.greatest(head.height, F.lit(1.0))
    half = wide * widths / 2
    return Box(F.greatest(x - half, F.lit(0.0)), F.greatest(head.y1 - high * above, F.lit(0.0)), F.least(x + half, F.lit(frame_width)), F.least(head.y1 + high * heights, F.lit(frame_height)))


def motion_region(vehicle: Box, frame_width: int, frame_height: int, margin: float = 0.6) -> Box:
    """The vehicle widened by a share of its longer side, in whole pixels of the frame."""
    m = vehicle.side * margin
    low = lambda x: F.greatest((x - m).cast("int"), F.lit(0))
    high = lambda x, most: F.least((x + m).cast("int"), F.lit(most))
    return Box(low(vehicle.x1), low(vehicle.y1), high(vehicle.x2, frame_width), high(vehicle.y2, frame_height))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0.0))


def temporal_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    both = overlap(start_a, end_a, start_b, end_b)
    return both / ((end_a - start_a) + (end_b - start_b) - both)


def decayed(confidence: Column, decay: float) -> Column:
    return F.greatest(F.lit(0.01), confidence * decay)


def image_size(width: Column, height: Column, configured: int) -> Column:
    return F.least(F.lit(configured), F.greatest(F.lit(640), width, height))


def timeline_pixel(at: Column, duration: Column, width: Column) -> Column:
    return (at / duration * (width - 1)).cast("int")
