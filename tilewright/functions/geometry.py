"""Box geometry as column expressions.  Boxes are columns x0, y0, x1, y1 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side(prefix: str, axis: str) -> tuple[Column, Column]:
    return F.col(f"{prefix}{axis}0"), F.col(f"{prefix}{axis}1")


def extent(a: str, b: str, axis: str) -> Column:
    """Shared length of two boxes on an axis, never negative."""
    (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def overlap(a: str, b: str) -> Column:
    """Shared area; 0 for boxes that only touch."""
    return extent(a, b, "x") * extent(a, b, "y")


def area(a: str) -> Column:
    (x0, x1), (y0, y1) = side(a, "x"), side(a, "y")
    return (x1 - x0) * (y1 - y0)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    return ratio(overlap(a, b), area(a) + area(b) - overlap(a, b))


def cover(a: str, b: str) -> Column:
    """Share of box a that box b covers."""
    return ratio(overlap(a, b), area(a))


def intersects(a: str, b: str) -> Column:
    """Strict intersection, as four comparisons that a join can evaluate early."""
    tests = []
    for axis in "xy":
        (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
        tests += [a0 < b1, b0 < a1]
    return tests[0] & tests[1] & tests[2] & tests[3]


def gap(a: str, b: str) -> Column:
    """Chebyshev distance of two boxes, 0 where they touch or overlap."""
    out = [F.lit(0)]
    for axis in "xy":
        (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
        out += [b0 - a1, a0 - b1]
    return F.greatest(*out)


def half_even(value: Column) -> Column:
    """Rounding to integer with ties to even."""
    return F.rint(value).cast("long")


def places(value: Column, n: int) -> Column:
    """Rounding to ``n`` decimal places, ties to even, by one rule on binary numbers that every engine computes alike."""
    return F.rint(value * 10.0**n) / F.lit(10.0**n)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def within_reach(x: Column, y: Column, box: str, reach: Column) -> Column:
    """Whether a point lies at most ``reach`` from a box, on both axes."""
    (x0, x1), (y0, y1) = side(box, "x"), side(box, "y")
    return F.greatest(x0 - x, x - x1, y0 - y, y - y1, F.lit(0)) <= reach


def centre_inside(box: str, rect: str) -> Column:
    """Whether a box's centre lies in a rectangle, its sides included."""
    tests = []
    for axis in "xy":
        (a0, a1), (r0, r1) = side(box, axis), side(rect, axis)
        tests.append(((a0 + a1) / 2).between(r0, r1))
    return tests[0] & tests[1]


def inside_by(box: str, rect: str, margin: Column) -> Column:
    """Whether a box lies inside a rectangle with ``margin`` to spare on every side."""
    (x0, x1), (y0, y1) = side(box, "x"), side(box, "y")
    (r0, r1), (s0, s1) = side(rect, "x"), side(rect, "y")
    return (x0 >= r0 + margin) & (y0 >= s0 + margin) & (x1 <= r1 - margin) & (y1 <= s1 - margin)


def presented_scale(downscale: Column) -> Column:
    """Scale of an image that was reduced by a factor; none or one leaves it."""
    return F.when(F.coalesce(downscale, F.lit(1)) <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / downscale)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
