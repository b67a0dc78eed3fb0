"""Draw operations on masks: polygons, thick lines and discs that paint or erase, in order.

A pixel belongs to a shape when its centre does.  Each mask's operations fold in order in
one Arrow task row; masks are independent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tilewright.operators.runs import checked_counts, counts_of, encode_counts, mask_of

KINDS = ("polygon", "line", "disc")


def parse_ops(text: str) -> list[dict]:
    """Operations from JSON, coordinates rounded to two places; an undo takes back the last one.

    Each has kind, points, width (of lines) or radius (of discs) and erase.  A polygon of
    fewer than three points is left out; an unknown kind raises ValueError.
    """
    out: list[dict] = []
    for op in json.loads(text or "[]"):
        if op.get("kind") == "undo":
            del out[-1:]
            continue
        if op.get("kind") not in KINDS:
            raise ValueError(f"no such operation: {op.get('kind')!r}")
        points = [(round(float(x), 2), round(float(y), 2)) for x, y in op.get("points", ())]
        if points and not (op["kind"] == "polygon" and len(points) < 3):
            out.append({"kind": op["kind"], "points": points, "size": float(op.get("width", op.get("radius", 1))), "erase": bool(op.get("erase"))})
    return out


def _polygon(x: np.ndarray, y: np.ndarray, points: Sequence[tuple[float, float]]) -> np.ndarray:
    """Even-odd: a centre is inside when a ray to its right crosses the outline an odd number of times."""
    odd = np.zeros(np.broadcast(x, y).shape, bool)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay != by:
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            odd ^= spans & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


def _stroke(x: np.ndarray, y: np.ndarray, points: Sequence[tuple[float, float]], radius: float) -> np.ndarray:
    """Centres within ``radius`` of the line through the points: round caps and joints."""
    near = np.zeros(np.broadcast(x, y).shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] or points, strict=len(points) == 1):
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / length, 0, 1) if length else 0.0
        near |= (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= radius * radius
    return near


def shape_of(op: dict, height: int, width: int) -> np.ndarray:
    x, y = np.arange(width)[None, :] + 0.5, np.arange(height)[:, None] + 0.5
    if op["kind"] == "polygon":
        return _polygon(x, y, op["points"])
    if op["kind"] == "line":
        return _stroke(x, y, op["points"], op["size"] / 2)
    out = np.zeros((height, width), bool)
    for point in op["points"]:
        out |= _stroke(x, y, [point], op["size"])
    return out


def draw(mask: np.ndarray, ops: Sequence[dict]) -> np.ndarray:
    """The mask after all operations."""
    out = mask.copy()
    for op in ops:
        shape = shape_of(op, *mask.shape)
        out = out & ~shape if op["erase"] else out | shape
    return out


def draw_masks(masks: DataFrame, ops: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, counts, area, erased) of masks (key, counts) after their operations (key, ops JSON); masks without any stay.

    ``erased``: nothing is left, which a caller refuses to store.
    """
    joined = masks.select(key, "counts").join(ops.select(key, "ops"), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, raw, text in zip(batch[key], batch["counts"], batch["ops"], strict=True):
                mask = mask_of(checked_counts(bytes(raw), height, width), height, width)
                mask = draw(mask, parse_ops(text or "[]"))
                rows.append((k, encode_counts(counts_of(mask)), int(mask.sum()), not mask.any()))
            yield pd.DataFrame(rows, columns=[key, "counts", "area", "erased"])

    return joined.mapInPandas(run, f"{key} long, counts binary, area long, erased boolean")


def update_masks(masks: DataFrame, ops: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """The masks with those drawn on replaced; ValueError if an operation erases one entirely."""
    drawn = draw_masks(masks.join(ops.select(key), key, "left_semi"), ops, key, height, width)
    gone = sorted(r[0] for r in drawn.where("erased").select(key).limit(20).collect())
    if gone:
        raise ValueError(f"nothing is left of masks {gone}")
    rest = masks.join(drawn.select(key), key, "left_anti").select(key, "counts")
    return rest.unionByName(drawn.select(key, "counts"))
