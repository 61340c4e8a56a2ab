"""Box algebra on normalised page coordinates as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x", "y", "width", "height")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Chained box steps name their input several times each; inlined, the expression
    would grow with every step, so long chains bind the intermediate box instead.
    """
    return F.transform(F.array(value), use)[0]


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


class Box(NamedTuple):
    """A rectangle whose four parts are columns."""

    x: Column
    y: Column
    width: Column
    height: Column

    @classmethod
    def columns(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{f}") for f in FIELDS])

    @classmethod
    def struct(cls, value: Column) -> Box:
        return cls(*[value[f] for f in FIELDS])

    @classmethod
    def edges(cls, left: Column, top: Column, right: Column, bottom: Column) -> Box:
        return cls(left, top, right - left, bottom - top)

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height

    @property
    def center_x(self) -> Column:
        return self.x + self.width / 2

    @property
    def center_y(self) -> Column:
        return self.y + self.height / 2

    @property
    def area(self) -> Column:
        return self.width * self.height

    def clamp(self) -> Box:
        left, top = clip01(self.x), clip01(self.y)
        right = F.least(F.greatest(self.right, left), F.lit(1.0))
        bottom = F.least(F.greatest(self.bottom, top), F.lit(1.0))
        return Box.edges(left, top, right, bottom)

    def expand(self, fraction: float) -> Box:
        dx, dy = self.width * max(0.0, fraction), self.height * max(0.0, fraction)
        return Box(self.x - dx, self.y - dy, self.width + dx * 2, self.height + dy * 2).clamp()

    def union(self, other: Box) -> Box:
        return Box.edges(
            F.least(self.x, other.x),
            F.least(self.y, other.y),
            F.greatest(self.right, other.right),
            F.greatest(self.bottom, other.bottom),
        ).clamp()

    def intersect(self, other: Box) -> Box:
        """Shared part; zero width and height when the boxes are disjoint."""
        left, top = F.greatest(self.x, other.x), F.greatest(self.y, other.y)
        right, bottom = F.least(self.right, other.right), F.least(self.bottom, other.bottom)
        meets = (right > left) & (bottom > top)
        return Box(
            left,
            top,
            F.when(meets, right - left).otherwise(F.lit(0.0)),
            F.when(meets, bottom - top).otherwise(F.lit(0.0)),
        ).clamp()

    def overlap_area(self, other: Box) -> Column:
        left, top = F.greatest(self.x, other.x, F.lit(0.0)), F.greatest(self.y, other.y, F.lit(0.0))
        right = F.least(self.right, other.right, F.lit(1.0))
        bottom = F.least(self.bottom, other.bottom, F.lit(1.0))
        return F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))

    def coverage(self, other: Box) -> Column:
        """Shared area over the smaller of the two areas, 0 for empty boxes."""
        smaller = F.least(self.area, other.area)
        return F.when(smaller > 0, self.overlap_area(other) / smaller).otherwise(F.lit(0.0))

    def share_inside(self, outer: Box) -> Column:
        """Part of this box that lies in ``outer``."""
        return F.when(self.area > 0, self.overlap_area(outer) / self.area).otherwise(F.lit(0.0))

    def iou(self, other: Box) -> Column:
        shared = self.overlap_area(other)
        joined = self.area + other.area - shared
        return F.when(joined > 0, shared / joined).otherwise(F.lit(0.0))

    def meets(self, other: Box) -> Column:
        return (
            (self.x < other.right) & (other.x < self.right) & (self.y < other.bottom) & (other.y < self.bottom)
        )

    def as_struct(self) -> Column:
        return F.struct(*[value.alias(f) for f, value in zip(FIELDS, self)])

    def named(self, prefix: str = "") -> list[Column]:
        return [value.alias(f"{prefix}{f}") for f, value in zip(FIELDS, self)]
