"""Full reading order of character boxes: columns by growth, regions by least rectangles, double lines by sub-columns.

An image is ordered by itself, many images to a call. Pairs are met by cells or by a sweep over x, so work follows what
lies close together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.groups import map_groups

#: Fixed values of the order: tolerance of a side, shared width of stacked and of nested regions, vertical distance, rounds, the raster on which
#: regions are drawn, shared area of nested regions.
EDGE, STACKED, NESTED, GAP, ROUNDS, RASTER, SHARED = 10, 0.4, 0.7, 300, 5, 4, 0.1
#: Fixed values of small characters: tolerance of a side, area of the smaller and of both that two sub-columns share.
SIDE, PART, BOTH = 5, 0.3, 0.2
#: Boxes of a page up to which a column looks at all of them.
FEW = 24

Box = Sequence[float]
Rect = tuple[float, ...]  # x, y of left top, right top, right bottom, left bottom


class _Sets:
    """Sets of 0 … n - 1, each named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


# ---------------------------------------------------------------- rectangles


def hull(points: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, counter-clockwise from the least, without points on its sides."""
    todo = sorted(points)
    if len(todo) < 3:
        return todo
    out: list[tuple[int, int]] = []
    for way in (todo, todo[::-1]):
        chain: list[tuple[int, int]] = []
        n = 0
        for p in way:
            x, y = p
            while n > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (y - ay) > (by - ay) * (x - ax):
                    break
                chain.pop()
                n -= 1
            chain.append(p)
            n += 1
        chain.pop()
        out += chain
    return out


def least_rectangle(points: set[tuple[int, int]]) -> list[tuple[float, float]]:
    """Corners of the rectangle of least area around points; one of its sides lies on a side of their hull. Of equal ones the
    one that lies straightest."""
    h = hull(points)
    if len(h) < 3:
        return [h[0], h[-1], h[-1], h[0]]
    best, lean, found, upright = math.inf, math.inf, None, False
    ax, ay = h[-1]
    for bx, by in h:
        dx, dy = bx - ax, by - ay
        ax, ay = bx, by
        if not dx or not dy:
            if upright:  # all upright sides give one rectangle
                continue
            upright = True
        along, across = [x * dx + y * dy for x, y in h], [y * dx - x * dy for x, y in h]
        a1, a2, c1, c2 = min(along), max(along), by * dx - bx * dy, max(across)  # the hull lies on one side of each of its own
        square = dx * dx + dy * dy
        area, slant = (a2 - a1) * (c2 - c1) / square, min(abs(dx), abs(dy)) / math.sqrt(square)
        if area < best * (1 - 1e-9) or (area <= best * (1 + 1e-9) and slant < lean):
            best, lean, found = area, slant, (dx, dy, square, a1, a2, c1, c2)
    dx, dy, square, a1, a2, c1, c2 = found
    return [((a * dx - c * dy) / square, (a * dy + c * dx) / square) for a, c in ((a1, c1), (a2, c1), (a2, c2), (a1, c2))]


def _whole(v: float) -> int:
    """Towards zero; what rounding put next to a whole number is that number."""
    return round(v) if abs(v - round(v)) < 1e-3 else int(v)


def rectangle(boxes: Sequence[Box]) -> Rect:
    """The least rectangle around boxes as they are drawn on the raster, its corners clockwise from the left top, by their angle
    around the middle."""
    points = set()
    for left, top, right, bottom in boxes:
        x1, y1, x2, y2 = int(int(left) / RASTER), int(int(top) / RASTER), int(int(right) / RASTER), int(int(bottom) / RASTER)
        points.update(((x1, y1), (x1, y2), (x2, y1), (x2, y2)))
    if len(boxes) > 1:
        xs, ys = zip(*points, strict=True)
        x1, y1, x2, y2 = min(xs), min(ys), max(xs), max(ys)
    if x1 < x2 and y1 < y2 and (len(boxes) == 1 or points.issuperset(((x1, y1), (x2, y1), (x2, y2), (x1, y2)))):
        x1, y1, x2, y2 = RASTER * x1, RASTER * y1, RASTER * x2, RASTER * y2
        return x1, y1, x2, y1, x2, y2, x1, y2
    corners = [(_whole(x), _whole(y)) for x, y in least_rectangle(points)]
    mx, my = sum(p[0] for p in corners) / 4, sum(p[1] for p in corners) / 4
    corners.sort(key=lambda p: math.atan2(p[1] - my, p[0] - mx))
    return tuple(RASTER * v for p in corners for v in p)


def corners_of(r: Rect) -> list[tuple[float, float]]:
    """Whole corners needn't be those of a rectangle any more: their hull."""
    x1, y1, x2, y2 = r[0], r[1], r[4], r[5]
    if x1 < x2 and y1 < y2 and r == (x1, y1, x2, y1, x2, y2, x1, y2):
        return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return hull(set(zip(r[::2], r[1::2], strict=True)))


def area(polygon: Sequence[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], *polygon[:1]], strict=True))) / 2


def shared_area(p: Rect, q: Rect) -> float:
    """Area that two rectangles of some area, in any position, have in common: one is cut by each side of the other."""
    left, clip = corners_of(p), corners_of(q)
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in left]
        cut = []
        for (x, y), s, (nx, ny), t in zip(left, side, left[1:] + left[:1], side[1:] + side[:1], strict=True):
            if s >= 0:
                cut.append((x, y))
            if s * t < 0:
                cut.append((x + (nx - x) * s / (s - t), y + (ny - y) * s / (s - t)))
        left = cut
        if len(left) < 3:
            return 0.0
    return area(left)


# ---------------------------------------------------------------- relations of regions


def _wide(p: Rect, q: Rect) -> float:
    """The most of a side that the lower side of one shares, in x, with the upper side of the other."""

    def of(a1: float, a2: float, b1: float, b2: float) -> float:
        both = max(0, min(a2, b2) - max(a1, b1))
        return max(both / (a2 - a1) if a2 != a1 else 0, both / (b2 - b1) if b2 != b1 else 0)

    return max(of(p[6], p[4], q[0], q[2]), of(p[0], p[2], q[6], q[4]))


def stacked(p: Rect, q: Rect) -> bool:
    return min(abs(p[1] - q[5]), abs(p[5] - q[1])) < GAP and _wide(p, q) > STACKED


def nested(p: Rect, q: Rect) -> bool:
    if _wide(p, q) <= NESTED:
        return False
    least = min(area(corners_of(p)), area(corners_of(q)))
    return least > 0 and shared_area(p, q) / least > SHARED


def beside(p: Rect, q: Rect) -> bool:
    """Whether two sub-columns of small characters are one."""
    if _wide(p, q) > NESTED:
        return True
    a, b = area(corners_of(p)), area(corners_of(q))
    both = shared_area(p, q) if a and b else 0
    return both > 0 and (both / min(a, b) > PART or both / (a + b - both) > BOTH)


Region = tuple[list[int], Rect]  # places of its boxes, and its rectangle


def region(rows: list[int], boxes: Sequence[Box]) -> Region:
    return rows, rectangle([boxes[i] for i in rows])


def merged(regions: list[Region], boxes: Sequence[Box], linked: Callable[[Rect, Rect], bool]) -> list[Region]:
    """Regions joined where their rectangles are linked, in the order of their first. Only rectangles that share some x can
    be; a sweep finds those."""
    if len(regions) < 2:
        return regions
    span = [(min(r[0], r[2], r[4], r[6]), max(r[0], r[2], r[4], r[6])) for _, r in regions]
    sets, open_, any_ = _Sets(len(regions)), [], False
    for i in sorted(range(len(regions)), key=span.__getitem__):
        left = span[i][0]
        open_ = [j for j in open_ if span[j][1] > left]
        for j in open_:
            if linked(regions[i][1], regions[j][1]) and sets.find(i) != sets.find(j):
                sets.join(i, j)
                any_ = True
        open_.append(i)
    if not any_:
        return regions
    parts: dict[int, list[int]] = {}
    for i in range(len(regions)):
        parts.setdefault(sets.find(i), []).append(i)
    return [regions[p[0]] if len(p) == 1 else region([k for i in p for k in regions[i][0]], boxes) for p in parts.values()]


# ---------------------------------------------------------------- columns


def columns(b: Sequence[Box]) -> list[list[int]]:
    """The first free box opens a column; a free box joins if its left or right side is within EDGE of that side of the whole column so far, and its
    top or bottom within EDGE of the column's bottom or top. Boxes are gone through in order, again and again, until none joins.
    On pages of many boxes, cells find those that can join."""
    n, size, sides = len(b), 2 * EDGE, ((0, 1, 3), (0, 3, 1), (2, 1, 3), (2, 3, 1))
    cells: list[dict[tuple, list[int]]] = [{}, {}, {}, {}]
    if n > FEW:
        for i, box in enumerate(b):
            for cell, (x, y, _) in zip(cells, sides, strict=True):
                cell.setdefault((box[x] // size, box[y] // size), []).append(i)

    def close(ends: list[float]) -> list[int]:
        found = set()
        for cell, (x, y, other) in zip(cells, sides, strict=True):  # a top meets the bottom, a bottom the top
            for cx in {(ends[x] - EDGE) // size, (ends[x] + EDGE) // size}:
                for cy in {(ends[other] - EDGE) // size, (ends[other] + EDGE) // size}:
                    found.update(cell.get((cx, cy), ()))
        return sorted(found)

    free, out = [True] * n, []
    for i in range(n):
        if not free[i]:
            continue
        free[i], column, at, added = False, [i], 0, False
        x1, y1, x2, y2 = b[i]
        while True:
            for j in range(at, n) if n <= FEW else close([x1, y1, x2, y2]):
                if j >= at and free[j]:
                    p = b[j]
                    if (-EDGE <= p[0] - x1 <= EDGE or -EDGE <= p[2] - x2 <= EDGE) and (-EDGE <= p[1] - y2 <= EDGE or -EDGE <= p[3] - y1 <= EDGE):
                        break
            else:
                if not added:
                    break
                at, added = 0, False
                continue
            free[j], at, added = False, j + 1, True
            column.append(j)
            x1, y1, x2, y2 = min(x1, p[0]), min(y1, p[1]), max(x2, p[2]), max(y2, p[3])
        out.append(column)
    return out


def _downwards(b: Sequence[Box], rows: list[int]) -> list[int]:
    return sorted(rows, key=lambda i: (b[i][1], b[i][0], b[i][2], b[i][3], i))


def _leftwards(b: Sequence[Box], regions: list[Region]) -> list[Region]:
    """From right to left by their left side; of equal ones the later first."""
    left = [min(b[i][0] for i in rows) for rows, _ in regions]
    return [regions[g] for g in sorted(range(len(regions)), key=lambda g: (left[g], g), reverse=True)]


def double_lines(b: Sequence[Box], rows: list[int]) -> list[int]:
    """Small characters, from top to bottom, as sub-columns: grown by their sides, joined where they overlap, read from right to left."""
    free, groups = list(rows), []
    while free:
        group, x1, x2, grew = [free[0]], b[free[0]][0], b[free[0]][2], True
        free = free[1:]
        while grew:
            grew, left = False, []
            for i in free:
                if abs(b[i][0] - x1) <= SIDE or abs(b[i][2] - x2) <= SIDE:
                    group.append(i)
                    x1, x2, grew = min(x1, b[i][0]), max(x2, b[i][2]), True
                else:
                    left.append(i)
            free = left
        groups.append(group)
    if len(groups) == 1:
        return _downwards(b, rows)
    return [i for rows, _ in _leftwards(b, merged([region(g, b) for g in groups], b, beside)) for i in _downwards(b, rows)]


def _column_order(b: Sequence[Box], where: Region) -> list[int]:
    """A region from top to bottom. A character is large if it takes much of the region's width, or its middle part, where the middle follows the slant
    of the region; so is one before a character that would be large in its place, and the last, unless small ones are waiting. Runs of small ones form double lines."""
    if len(where[0]) == 1:
        return where[0]
    rows, (x0, y0, xr, _, _, _, x3, y3) = _downwards(b, where[0]), where[1]
    width = xr - x0

    def large(i: int, at: int) -> bool:
        left, right = int(b[i][0]), int(b[i][2])
        if not width:
            return right > left
        part = (right - left) / width
        middle = int((int(b[at][1]) - y0) / (y3 - y0 + 1e-4) * (x3 - x0) + x0 + width / 2)
        return part > 0.6 or (left <= middle <= right and 0.4 < (middle - left) / (right - middle + 1e-3) < 2.5 and part >= 0.45)

    out: list[int] = []
    small: list[int] = []
    for i, following in zip(rows, [*rows[1:], None], strict=True):
        if large(i, i) or (not small and (following is None or large(following, i))):
            out += double_lines(b, small) if small else []
            out.append(i)
            small = []
        else:
            small.append(i)
    return out + (double_lines(b, small) if small else [])


def reading_order(b: Sequence[Box]) -> list[int]:
    """Order of boxes (x1, y1, x2, y2). The widest come first into columns; columns join to regions where they are stacked, and regions where they
    lie within each other; regions are read from right to left by their left side, each from top to bottom. Equal boxes keep
    their places, and boxes are not cut off by an edge of the image."""
    if len(b) == 1:
        return [0]
    wide = sorted(range(len(b)), key=lambda i: b[i][0] - b[i][2])
    c = [b[i] for i in wide]
    regions = [region(rows, c) for rows in columns(c)]
    for _ in range(ROUNDS):
        before, regions = len(regions), merged(regions, c, stacked)
        if len(regions) == before:
            break
    return [wide[i] for r in _leftwards(c, merged(regions, c, nested)) for i in _column_order(c, r)]


def full_order(boxes: DataFrame, group: str = "image", idx: str = "idx") -> DataFrame:
    """Reading position of every box of an image, equal boxes included. Boxes of one image come to the order by ``idx``."""

    def order(c: dict[str, np.ndarray], image: np.ndarray):
        edges = [0, *(np.flatnonzero(np.diff(image)) + 1).tolist(), len(image)]
        b = list(zip(*[c[k].astype(float).tolist() for k in ("x1", "y1", "x2", "y2")], strict=True))
        by: list[int] = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            by += [lo + i for i in reading_order(b[lo:hi])]
        return np.array(by, int), {"reading_pos": np.arange(1, len(by) + 1) - np.array(edges)[image]}

    return map_groups(boxes, [group], [idx], order, ["x1", "y1", "x2", "y2"], "reading_pos int", together=True)
