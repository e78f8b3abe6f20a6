"""The reading order against its rules, written out with plain loops over all pairs."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithos.operators import reading as R

# ---------------------------------------------------------------- geometry by other ways


def plain_rectangle(points):
    """Least area over the directions of all pairs of points; corners as four points."""
    pts, best = sorted(points), None
    for (ax, ay), (bx, by) in itertools.permutations(pts, 2):
        t = math.atan2(by - ay, bx - ax)
        c, s = math.cos(t), math.sin(t)
        u, v = [x * c + y * s for x, y in pts], [y * c - x * s for x, y in pts]
        size = (max(u) - min(u)) * (max(v) - min(v))
        key = (round(size, 6), round(min(abs(c), abs(s)), 9))
        if best is None or key < best[0]:
            best = key, [(p * c - q * s, p * s + q * c) for p, q in ((min(u), min(v)), (max(u), min(v)), (max(u), max(v)), (min(u), max(v)))]
    return best[1] if best else pts * 4


def plain_region(boxes):
    pts = {(int(int(x) / 4), int(int(y) / 4)) for b in boxes for x in (b[0], b[2]) for y in (b[1], b[3])}
    near = lambda v: round(v) if abs(v - round(v)) < 1e-3 else math.trunc(v)
    c = [(near(x), near(y)) for x, y in plain_rectangle(pts)]
    mx, my = sum(x for x, _ in c) / 4, sum(y for _, y in c) / 4
    return [(4 * x, 4 * y) for x, y in sorted(c, key=lambda p: math.atan2(p[1] - my, p[0] - mx))]


def width_at(poly, y):
    """x from and to of a convex polygon at a height that no corner has."""
    xs = [ax + (bx - ax) * (y - ay) / (by - ay) for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True) if (ay < y) != (by < y)]
    return (min(xs), max(xs)) if xs else (0, 0)


def plain_shared(p, q):
    """Area by strips between the heights of corners and of crossing sides; in a strip the shared width is linear."""
    ys = {y for _, y in p + q}
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        for (cx, cy), (dx, dy) in zip(q, q[1:] + q[:1], strict=True):
            d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if d:
                ys.add(ay + (by - ay) * ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d)
    total, cuts = 0.0, sorted(ys)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1e-9:
            (p1, p2), (q1, q2) = width_at(p, (a + b) / 2), width_at(q, (a + b) / 2)
            total += max(0.0, min(p2, q2) - max(p1, q1)) * (b - a)
    return total


def plain_area(p):
    return plain_shared(p, p)


# ---------------------------------------------------------------- the order


def share(a, b, c, d):
    both = max(0, min(b, d) - max(a, c))
    return max([both / n for n in (b - a, d - c) if n] or [0])


def overlap(p, q):
    return max(share(p[3][0], p[2][0], q[0][0], q[1][0]), share(p[0][0], p[1][0], q[3][0], q[2][0]))


def plain_join(groups, b, linked):
    regions, label = [plain_region([b[i] for i in g]) for g in groups], list(range(len(groups)))
    for i, j in itertools.combinations(range(len(groups)), 2):
        if linked(regions[i], regions[j]):
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return [[k for g, x in zip(groups, label, strict=True) if x == y for k in g] for y in sorted(set(label))]


def plain_columns(b, fits):
    free, out = list(range(len(b))), []
    while free:
        col, grew = [free.pop(0)], True
        while grew:
            grew = False
            for i in list(free):
                if fits(b[i], (min(b[k][0] for k in col), min(b[k][1] for k in col), max(b[k][2] for k in col), max(b[k][3] for k in col))):
                    col.append(i)
                    free.remove(i)
                    grew = True
        out.append(col)
    return out


def right_to_left(groups, b):
    return [groups[g] for g in sorted(range(len(groups)), key=lambda g: (min(b[i][0] for i in groups[g]), g), reverse=True)]


def down(rows, b):
    return sorted(rows, key=lambda i: (b[i][1], b[i][0], b[i][2], b[i][3], i))


def plain_small(rows, b):
    c = [b[i] for i in rows]
    groups = plain_columns(c, lambda p, h: abs(p[0] - h[0]) <= 5 or abs(p[2] - h[2]) <= 5)

    def linked(p, q):
        x, y = plain_area(p), plain_area(q)
        both = plain_shared(p, q) if x and y else 0
        return overlap(p, q) > 0.7 or (both > 0 and (both / min(x, y) > 0.3 or both / (x + y - both) > 0.2))

    return [rows[i] for g in right_to_left(plain_join(groups, c, linked), c) for i in down(g, c)]


def plain_order(boxes):
    first = sorted(range(len(boxes)), key=lambda i: -(boxes[i][2] - boxes[i][0]))
    b = [boxes[i] for i in first]
    groups = plain_columns(b, lambda p, h: (abs(p[0] - h[0]) <= 10 or abs(p[2] - h[2]) <= 10) and (abs(p[1] - h[3]) <= 10 or abs(p[3] - h[1]) <= 10))
    for _ in range(5):
        new = plain_join(groups, b, lambda p, q: overlap(p, q) > 0.4 and (abs(p[0][1] - q[2][1]) < 300 or abs(p[2][1] - q[0][1]) < 300))
        done, groups = len(new) == len(groups), new
        if done:
            break

    def inside(p, q):
        least = min(plain_area(p), plain_area(q))
        return overlap(p, q) > 0.7 and least > 0 and plain_shared(p, q) / least > 0.1

    out = []
    for g in right_to_left(plain_join(groups, b, inside), b):
        region, rows = plain_region([b[i] for i in g]), down(g, b)
        width, notes = region[1][0] - region[0][0], []

        def big(i, at):
            x1, x2, y = int(b[i][0]), int(b[i][2]), int(b[at][1])
            if width == 0:  # noqa: B023
                return x2 > x1
            mid = int((y - region[0][1]) / (region[3][1] - region[0][1] + 1e-4) * (region[3][0] - region[0][0]) + region[0][0] + width / 2)  # noqa: B023
            return (x2 - x1) / width > 0.6 or (x1 <= mid <= x2 and 2 / 5 < (mid - x1) / (x2 - mid + 1e-3) < 5 / 2 and (x2 - x1) / width >= 0.45)  # noqa: B023

        for n, i in enumerate(rows):
            last = n == len(rows) - 1
            if big(i, i) or (not notes and (last or big(rows[n + 1], i))):
                out += [*plain_small(notes, b), i]
                notes = []
            else:
                notes.append(i)
        out += plain_small(notes, b)
    return [first[i] for i in out]


# ---------------------------------------------------------------- tests


def test_hand_made_pages():
    page = [(100, 0, 120, 20), (101, 22, 121, 40), (60, 0, 80, 20), (99, 42, 119, 60), (62, 22, 82, 44), (20, 0, 40, 18), (19, 21, 41, 39)]
    assert R.reading_order(page) == plain_order(page) == [0, 1, 3, 2, 4, 5, 6]
    assert R.reading_order([]) == [] and R.reading_order([(5, 5, 5, 5)]) == [0]
    assert R.reading_order([(0, 0, 9, 9)] * 3) == [0, 1, 2]
    # a column of large characters with a double line of four small ones between
    note = [(100, 0, 140, 40), (100, 44, 140, 84), (122, 88, 138, 104), (102, 89, 118, 105), (122, 106, 138, 122), (102, 107, 118, 123), (100, 128, 140, 168)]
    assert R.reading_order(note) == plain_order(note) == [0, 1, 2, 4, 3, 5, 6]


def test_slanted_columns_stay_apart():
    """Two columns leaning by half a character a row: their upright hulls overlap, their least rectangles do not."""
    lean = [(x + 9 * k, 42 * k, x + 9 * k + 40, 42 * k + 40) for x in (300, 240) for k in range(12)]
    assert R.reading_order(lean) == plain_order(lean) == list(range(24))
    right, left = R.rectangle(lean[:12]), R.rectangle(lean[12:])
    assert min(right[::2]) < max(left[::2]) and R.shared_area(right, left) < 0.02 * R.area(R.corners_of(right))
    assert right[1] != right[3] and len(set(right)) == 8


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=9))
def test_least_rectangle(points):
    got, want = R.least_rectangle(points), plain_rectangle(points)
    assert R.area(got) == pytest.approx(plain_area(want), abs=1e-4)
    hull = R.hull(points)
    turn = [(bx - ax) * (cy - by) - (by - ay) * (cx - bx) for (ax, ay), (bx, by), (cx, cy) in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2], strict=True)] if len(hull) > 2 else [1]
    assert min(turn) > 0 and set(hull) <= points


@settings(max_examples=150, deadline=None)
@given(*[st.tuples(*[st.integers(0, 30)] * 2, *[st.integers(1, 20)] * 2, st.integers(-9, 9)) for _ in range(2)])
def test_shared_area(a, b):
    def quad(x, y, w, h, lean):
        return (x, y, x + w, y + lean / 3, x + w - lean / 3, y + h + lean / 3, x - lean / 3, y + h)

    p, q = quad(*a), quad(*b)
    p_, q_ = R.corners_of(p), R.corners_of(q)
    if R.area(p_) and R.area(q_):
        assert R.shared_area(p, q) == pytest.approx(plain_shared(p_, q_), abs=1e-6) == pytest.approx(R.shared_area(q, p), abs=1e-6)


def test_random_pages():
    rnd = random.Random(4)
    for n in (1, 2, 5, 17, 30):
        for _ in range(12):
            wide = rnd.choice((120, 600))
            b = [(x, y, x + rnd.randint(1, 60), y + rnd.randint(1, 40)) for x, y in ((rnd.randint(0, wide), rnd.randint(0, 900)) for _ in range(n))]
            assert R.reading_order(b) == plain_order(b)


def test_pages_of_leaning_columns_with_double_lines():
    rnd = random.Random(9)
    for _ in range(10):
        b, x = [], 700.0
        lean = rnd.uniform(-8, 8)
        for _ in range(rnd.randint(1, 5)):
            y, size = rnd.uniform(0, 60), rnd.uniform(30, 44)
            for k in range(rnd.randint(2, 9)):
                left = x + lean * k
                if rnd.random() < 0.25:
                    b += [(left + s, y + d, left + s + size * 0.4, y + d + size * 0.4) for s in (0, size * 0.55) for d in (rnd.uniform(0, 2), size * 0.5)]
                else:
                    b.append((left, y, left + size + rnd.uniform(-3, 3), y + size))
                y += size + rnd.uniform(0, 8)
            x -= size + rnd.uniform(4, 30)
        rnd.shuffle(b)
        assert R.reading_order(b) == plain_order(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 500)] * 2, *[st.integers(0, 60)] * 2), max_size=25))
def test_order_is_a_permutation(rows):
    assert sorted(R.reading_order([(x, y, x + w, y + h) for x, y, w, h in rows])) == list(range(len(rows)))


def test_large_pages_take_work_that_follows_what_is_close():
    rng = np.random.default_rng(0)
    b = [(x, y, x + 30, y + 30) for x in range(0, 4000, 40) for y in range(0, 4000, 40)]
    rng.shuffle(b)
    order = R.reading_order(b)
    assert [b[i] if isinstance(b[i], tuple) else tuple(b[i]) for i in order[:100]] == [(3960, y, 3990, y + 30) for y in range(0, 4000, 40)]


SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="tables are not here")
def test_reading_order_full(spark):
    import duckdb

    from lithos.plans import boxes

    duck = duckdb.connect()
    for t in SF.iterdir():
        duck.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    images, want = {}, set()
    for image, idx, *box in duck.execute(f"WITH {boxes.BOXES} SELECT image, idx, x1, y1, x2, y2 FROM b ORDER BY image, idx").fetchall():
        images.setdefault(image, []).append((idx, *box))
    for image, rows in images.items():
        want |= {(image, rows[i][0], n) for n, i in enumerate(plain_order([r[1:] for r in rows]), 1)}
    assert {tuple(r) for r in boxes.reading_order_full(spark, str(SF)).collect()} == want
