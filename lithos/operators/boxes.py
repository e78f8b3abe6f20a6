"""Character boxes: fusion of two detectors, suppression, simple order, strips."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, coverage, iou, overlaps, rounded
from ..functions.groups import map_groups

#: Fixed values of the detectors.
IOU, CONTAIN, DAMAGE_SCORE = 0.5, 0.8, 0.3
NMS_BEFORE, NMS_AFTER = 30_000, 5_000
STRIP_EDGE, STRIP_SCALE = 1.0, 0.03


#: Tolerance of areas of triangles.
_NEAR = 1e-6
#: Side of a cell of the grid on which boxes meet: some characters wide, so that most boxes lie in one or two.
CELL = 256.0


def meeting(a: DataFrame, b: DataFrame, group: str, pa: str, pb: str, cell: float = CELL) -> DataFrame:
    """Rows of a and b, of the same ``group``, whose boxes (columns x1 … y2 with the prefixes pa and pb) meet, edges included; each pair once.

    Boxes are dealt to the cells of a grid that they touch and meet there; a pair counts in the cell of the left upper corner of what it shares. So an
    image of any number of boxes is joined cell by cell, not box by box, and a crowded one by many tasks. Boxes without
    extent are points; a null coordinate or a right side left of the left one meets nothing."""

    def dealt(df: DataFrame, p: Box) -> DataFrame:
        at = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
        return df.where((p.x1 <= p.x2) & (p.y1 <= p.y2)).withColumn("__cx", at(p.x1, p.x2)).withColumn("__cy", at(p.y1, p.y2))

    p, q = Box.of(pa), Box.of(pb)
    both = dealt(a, p).join(dealt(b, q), [group, "__cx", "__cy"]).where(overlaps(p, q))
    here = (F.floor(F.greatest(p.x1, q.x1) / cell) == F.col("__cx")) & (F.floor(F.greatest(p.y1, q.y1) / cell) == F.col("__cy"))
    return both.where(here).drop("__cx", "__cy")


def prefixed(boxes: DataFrame, group: str, idx: str, prefix: str) -> DataFrame:
    """(group, prefix, prefix_x1 …): boxes named for a join."""
    return boxes.select(group, F.col(idx).alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2")])


def damage_boxes(raw: DataFrame) -> DataFrame:
    """Boxes above the score, with whole coordinates, half to even."""
    return raw.where(F.col("score") > DAMAGE_SCORE).select("image", "idx", *rounded(Box.of()))


def fuse(damage: DataFrame, ocr: DataFrame, least_iou: float = IOU, contain: float = CONTAIN) -> DataFrame:
    """(image, status, idx, x1, y1, x2, y2) of damage(image, idx, box) and ocr(image, idx, box).

    A text box with that IoU with a damage box goes. A damage box that instead covers, or is covered by, a text box
    takes the extent of the one with most coverage, the first of equal ones; that text box goes too, and
    damage boxes promoted to the same box are one. Boxes meet on a grid, once; what becomes of a box that meets another is told by windows over those pairs.
    """
    sides = ("x1", "y1", "x2", "y2")
    d, o = prefixed(damage, "image", "idx", "d"), prefixed(ocr, "image", "idx", "o")
    a, b = Box.of("d_"), Box.of("o_")
    # as an explosion of one row: as columns, each would be written out wherever it is used, in a method too long to be compiled
    shares = F.inline(F.array(F.struct(iou(a, b).alias("iou"), coverage(a, b).alias("cover"))))
    same = F.col("iou") >= least_iou
    pairs = meeting(d, o, "image", "d_", "o_").select("*", shares).where(same | ((F.col("iou") < least_iou) & (F.col("cover") >= contain)))
    of = lambda side: Window.partitionBy("image", side)
    met = pairs.select("image", "d", "o", "cover", F.max(same).over(of("o")).alias("same"), *[F.col(f"o_{c}").alias(c) for c in sides])
    best = F.row_number().over(of("d").orderBy("same", F.desc("cover"), "o"))
    met = met.withColumn("best", best).where(F.col("same") | (F.col("best") == 1))
    met = met.withColumn("n", F.row_number().over(of("o").orderBy("d")))
    first = F.col("n") == 1
    box = lambda damaged, idx, keep: F.struct(F.lit(damaged).alias("damaged"), F.col(idx).alias("idx"), *[F.when(keep, F.col(c)).alias(f"p_{c}") for c in sides], (~keep).alias("gone"))
    told = F.filter(F.array(F.when(first, box(False, "o", F.lit(False))), F.when(~F.col("same"), box(True, "d", first))), lambda t: t.isNotNull())
    told = met.select("image", F.explode(told).alias("t")).select("image", "t.*")
    every = damage.select("image", F.lit(True).alias("damaged"), "idx", *sides).unionByName(ocr.select("image", F.lit(False).alias("damaged"), "idx", *sides))
    left = every.join(told, ["image", "damaged", "idx"], "left").where(~F.coalesce("gone", F.lit(False)))
    return left.select("image", F.when(F.col("damaged"), "damaged").otherwise("intact").alias("status"), "idx", *[F.coalesce(f"p_{c}", c).alias(c) for c in sides])


def simple_order(boxes: DataFrame, group: str = "image", idx: str = "idx") -> DataFrame:
    """Reading position: right to left by centre, then top to bottom."""
    x, y = Box.of().mid
    return boxes.withColumn("reading_pos", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(x), y, idx)))


def confident(pred: DataFrame, least: float, classes: int, multi_label: bool = True) -> DataFrame:
    """pred(image, idx, box, objectness, scores array) -> one row per box and class over the confidence; with
    one class the objectness is the score; without multi_label the best class only."""
    p = pred.where(F.col("objectness") > least)
    s = F.transform("scores", lambda c: c * F.col("objectness")) if classes > 1 else F.array(F.col("objectness"))
    p = p.withColumn("__s", s)
    p = p.select("image", "idx", "x1", "y1", "x2", "y2", F.posexplode("__s").alias("cls", "score")).where(F.col("score") > least)
    if multi_label:
        return p
    best = F.row_number().over(Window.partitionBy("image", "idx").orderBy(F.desc("score"), "cls"))
    return p.withColumn("__r", best).where("__r = 1").drop("__r")


def nms(boxes: DataFrame, least_iou: float = 0.2, before: int = NMS_BEFORE, after: int = NMS_AFTER) -> DataFrame:
    """Greedy suppression within (image, cls): boxes in falling score, each dropping later ones over the
    IoU. The limits are part of the operator: the best ``before`` boxes of an image go in, ``after`` stay."""
    top = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "idx"))
    pool = boxes.withColumn("__r", top).where(F.col("__r") <= before).drop("__r")

    def best_first(c: dict[str, np.ndarray], group: np.ndarray):
        # all groups of a batch at once: in each round the best box left of every group stays, and drops others of its group
        left = np.lexsort((c["idx"], -c["score"], group))
        box = np.stack([c[k].astype(float) for k in ("x1", "y1", "x2", "y2")])
        area = (box[2] - box[0]) * (box[3] - box[1])
        stay = []
        while len(left):
            first = np.ones(len(left), bool)
            first[1:] = group[left[1:]] != group[left[:-1]]
            best = left[first]
            stay.append(best)
            of = best[np.cumsum(first) - 1][~first]
            left = left[~first]
            low, high = np.maximum(box[:2, of], box[:2, left]), np.minimum(box[2:, of], box[2:, left])
            both = np.clip(high - low, 0, None).prod(axis=0)
            left = left[~(both / np.maximum(area[of] + area[left] - both, 1e-12) > least_iou)]
        return np.sort(np.concatenate(stay)), {}

    kept = map_groups(pool, ["image", "cls"], ["idx"], best_first, ["idx", "score", "x1", "y1", "x2", "y2"], together=True)
    return kept.withColumn("__r", top).where(F.col("__r") <= after).drop("__r")


def strips(images: DataFrame, group: str = "page", idx: str = "idx") -> DataFrame:
    """Stacked strips of one picture merged: (group, x1, y1, x2, y2, scale, n). From top to bottom, a strip joins the one group
    whose sides and lower edge it meets within a point, at nearly its scale; where it fits none or several it opens one. The groups
    so far are the state of a fold over a page's strips."""
    named = ("x1", "y1", "x2", "y2", "scale")
    items = F.array_sort(F.collect_list(F.struct("y1", "x1", F.col(idx).alias("i"), "x2", "y2", "scale")))
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,scale:double,n:int>>"

    def step(groups: Column, r: Column) -> Column:
        close = lambda a, b: F.abs(a - b) <= STRIP_EDGE
        fits = F.transform(groups, lambda g: close(g["x1"], r["x1"]) & close(g["x2"], r["x2"]) & close(g["y2"], r["y1"]) & (F.abs(g["scale"] - r["scale"]) <= STRIP_SCALE * r["scale"]))
        one = F.struct(*[r[c].cast("double").alias(c) for c in named], F.lit(1).alias("n"))

        def grown(g: Column) -> Column:
            ends = [F.least(g["x1"], r["x1"]), F.least(g["y1"], r["y1"]), F.greatest(g["x2"], r["x2"]), F.greatest(g["y2"], r["y2"]), F.greatest(g["scale"], r["scale"])]
            return F.struct(*[e.cast("double").alias(c) for e, c in zip(ends, named, strict=True)], (g["n"] + 1).alias("n"))

        only = F.size(F.filter(fits, lambda f: f)) == 1
        return F.when(only, F.transform(groups, lambda g, i: F.when(F.get(fits, i), grown(g)).otherwise(g))).otherwise(F.concat(groups, F.array(one)))

    folded = images.groupBy(group).agg(items.alias("s")).select(group, F.explode(F.aggregate("s", F.expr(f"cast(array() as {kind})"), step)).alias("g"))
    return folded.select(group, "g.*")


def face_candidates(images: DataFrame, width: float = 60, height: float = 35, pixels: float = 150) -> DataFrame:
    return images.where((F.col("x2") - F.col("x1") >= width) & (F.col("y2") - F.col("y1") >= height) & (F.col("pixel_width") >= pixels))


def grouped_hits(boxes: DataFrame, area: DataFrame, group: str) -> DataFrame:
    """Boxes that a marquee of their group meets, edges included, once for each."""
    m = area.select(F.col(group), *[F.col(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")])
    return meeting(boxes, m, group, "", "m_").select(*boxes.columns)


def unseen(first: DataFrame, second: DataFrame, least: float = IOU, group: str = "image", idx: str = "idx") -> DataFrame:
    """Boxes of ``first`` that none of ``second``, in the same group, has found as well: no one shares more than ``least`` of their union or of the smaller one.
    Shared sides count a point more, as pixels do; the area of a first box counts in whole points."""
    b = second.select(group, *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")], *[(F.col(c) + 1).alias(f"t_{c}") for c in ("x2", "y2")], F.col("x1").alias("t_x1"), F.col("y1").alias("t_y1"))
    wide = first.select(group, idx, *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")], F.col("x1").alias("g_x1"), F.col("y1").alias("g_y1"), (F.col("x2") + 1).alias("g_x2"), (F.col("y2") + 1).alias("g_y2"))
    p, q = Box.of("f_"), Box.of("s_")
    side = lambda lo1, hi1, lo2, hi2: F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2) + 1, F.lit(0.0))
    both = side(p.x1, p.x2, q.x1, q.x2) * side(p.y1, p.y2, q.y1, q.y2)
    one, other = ((p.x2 - p.x1) * (p.y2 - p.y1)).cast("long"), (q.x2 - q.x1) * (q.y2 - q.y1)
    union, smaller = one + other - both, F.least(one.cast("double"), other)
    found = meeting(wide, b, group, "g_", "t_").where(((union > 0) & (both / F.nullif(union, F.lit(0.0)) > least)) | ((smaller > 0) & (both / F.nullif(smaller, F.lit(0.0)) > least)))
    return first.join(found.select(group, idx).distinct(), [group, idx], "left_anti")


def points_in(points: DataFrame, quads: DataFrame, group: str) -> DataFrame:
    """points(group, x, y, …) with the rows of quads(group, qx1, qy1, … qx4, qy4, …) that hold them: those where the areas of the triangles between the point
    and the sides of one half of the quadrangle add up to that half, so the border belongs to it."""
    corner = [(F.col(f"qx{i}"), F.col(f"qy{i}")) for i in (1, 2, 3, 4)]
    ends = [f([c[k] for c in corner]) for k in (0, 1) for f in (lambda c: F.least(*c) - _NEAR, lambda c: F.greatest(*c) + _NEAR)]
    q = quads.withColumns(dict(zip(("__q_x1", "__q_x2", "__q_y1", "__q_y2"), ends, strict=True)))
    p = points.withColumns({f"__p_{c}{i}": F.col(c) for c in ("x", "y") for i in (1, 2)})
    here = (F.col("x"), F.col("y"))

    def triangle(a, b, c) -> Column:
        return F.abs(a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1])) / 2

    def holds(a, b, c) -> Column:
        return F.abs(triangle(a, b, c) - triangle(here, b, c) - triangle(a, here, c) - triangle(a, b, here)) < _NEAR

    found = meeting(p, q, group, "__p_", "__q_").where(holds(corner[0], corner[1], corner[2]) | holds(corner[0], corner[2], corner[3]))
    return found.drop(*[c for c in found.columns if c.startswith(("__p_", "__q_"))])


def anchored_rows(chips: DataFrame, group: str, idx: str = "idx") -> DataFrame:
    """chips(group, idx, left, top, bottom, …) with row and place, counted from 1. In their order, a chip joins the first row whose top is nearer to its own than
    half its height, 8 at least, and takes the row's top up and its bottom down with it; else it opens a row. Rows are read from the top, chips of a row
    from the left. The rows of a group so far are the state of a fold over its chips."""
    items = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))))
    empty = F.struct(F.filter(F.array(F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))), lambda r: F.lit(False)).alias("rows"), F.filter(F.array(F.lit(0)), lambda r: F.lit(False)).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        rows, at = acc["rows"], acc["at"]
        fits = F.transform(rows, lambda r: F.abs(r["top"] - c["top"]) < F.greatest(F.lit(8.0), (c["bottom"] - c["top"]) / 2))
        found = F.array_position(fits, True).cast("int")
        one = F.struct(c["top"].alias("top"), c["bottom"].alias("bottom"))
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == found, F.struct(F.least(r["top"], c["top"]).alias("top"), F.greatest(r["bottom"], c["bottom"]).alias("bottom"))).otherwise(r))
        new = F.when(found > 0, grown).otherwise(F.concat(rows, F.array(one)))
        return F.struct(new.alias("rows"), F.concat(at, F.array(F.when(found > 0, found).otherwise(F.size(rows) + 1))).alias("at"))

    folded = chips.groupBy(group).agg(items.alias("c")).select(group, "c", F.aggregate("c", empty, step).alias("f"))
    rows = F.col("f.rows")
    down = F.transform(rows, lambda r, i: (F.size(F.filter(rows, lambda o, j: (o["top"] < r["top"]) | ((o["top"] == r["top"]) & (j <= i))))).cast("int"))
    placed = folded.select(group, F.posexplode("c").alias("n", "e"), F.col("f.at").alias("at"), down.alias("down"))
    placed = placed.select(group, F.col("e.i").alias(idx), F.element_at("down", F.get("at", "n")).alias("row"))
    left = F.row_number().over(Window.partitionBy(group, "row").orderBy("left", idx)).alias("place")
    return chips.join(placed, [group, idx]).select(*chips.columns, "row", left)
