"""Boxes, crops, glyphs, flags, sources and sinks."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.functions import geometry as G
from lithos.operators import boxes as B
from lithos.operators import glyphs as Y
from lithos.operators import reading
from lithos.operators import validate as V
from lithos.sources import readers, sinks
from lithos.streaming.latest import latest_table, start_latest

BOX = "image string, idx int, x1 double, y1 double, x2 double, y2 double"


def fused(spark, d, o):
    mk = lambda rows: spark.createDataFrame([("i", k, *map(float, r)) for k, r in enumerate(rows)], BOX)
    return [(r.status, (r.x1, r.y1, r.x2, r.y2)) for r in B.fuse(mk(d), mk(o)).orderBy("status", "idx").collect()]


def test_fusion(spark):
    ocr = [[10, 10, 30, 30], [40, 10, 50, 30]]
    assert fused(spark, [[11, 11, 29, 29]], ocr) == [("damaged", (11, 11, 29, 29)), ("intact", (40, 10, 50, 30))]
    assert fused(spark, [[15, 15, 25, 25]], ocr) == [("damaged", (10, 10, 30, 30)), ("intact", (40, 10, 50, 30))]
    assert fused(spark, [[15, 15, 25, 25], [16, 16, 24, 24]], ocr)[0] == ("damaged", (10, 10, 30, 30)) and len(fused(spark, [[15, 15, 25, 25], [16, 16, 24, 24]], ocr)) == 2
    raw = spark.createDataFrame([("i", 0, 1.2, 2.8, 30.1, 40.7, 0.31), ("i", 1, 0.0, 0.0, 1.0, 1.0, 0.3)], BOX + ", score double")
    assert [tuple(r)[2:] for r in B.damage_boxes(raw).collect()] == [(1, 3, 30, 41)]


def test_crop_and_validity(spark):
    def size(w, h):
        b = G.Box(F.lit(0.0), F.lit(0.0), F.lit(float(w)), F.lit(float(h)))
        r = spark.range(1).select(G.crop_size(b)[1].alias("w"), G.crop_size(b)[2].alias("h")).first()
        return r.w, r.h

    assert size(5000, 3000) == (4096, 2458) and size(5000, 6000) == (3413, 4096) and size(10, 20) == (10, 20)
    bad = [(5.0, 0.0, 4.0, 9.0), (-1.0, 0.0, 4.0, 9.0), (0.0, 0.0, 101.0, 9.0), (float("nan"), 0.0, 4.0, 9.0), (0.0, 0.0, float("inf"), 9.0)]
    df = spark.createDataFrame([*bad, (0.0, 0.0, 100.0, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [r.ok for r in df.select(G.valid(G.Box.of(), F.lit(100), F.lit(10)).alias("ok")).collect()] == [False] * 5 + [True]
    r = spark.range(1).select(G.corners(G.Box(*[F.lit(float(x)) for x in (1, 2, 3, 4)])).alias("c"))
    ok, box = G.from_corners(F.col("c"))
    assert tuple(r.select(ok, *box).first()) == (True, 1, 2, 3, 4)


def test_orders(spark):
    df = spark.createDataFrame([("i", k, x, 0.0, x + 10, 10.0) for k, x in enumerate((0.0, 20.0, 40.0))], BOX)
    assert [r.x1 for r in B.simple_order(df).orderBy("reading_pos").collect()] == [40, 20, 0]
    col = spark.createDataFrame([("i", k, 100.0 - 50 * (k // 3), 12.0 * (k % 3), 120.0 - 50 * (k // 3), 12.0 * (k % 3) + 10) for k in range(6)] + [("j", 0, 0.0, 0.0, 1.0, 1.0), ("j", 1, 0.0, 0.0, 1.0, 1.0)], BOX)
    got = reading.full_order(col)
    assert [r.idx for r in got.where("image = 'i'").orderBy("reading_pos").collect()] == list(range(6))
    assert got.where("image = 'j'").count() == 2  # equal boxes stay


def test_nms_and_strips(spark):
    rng = np.random.default_rng(1)
    rows = [("i", k, *map(float, (x, y, x + 20, y + 20)), float(s), 0) for k, (x, y, s) in enumerate(zip(rng.integers(0, 60, 40), rng.integers(0, 60, 40), rng.random(40), strict=True))]
    kept = B.nms(spark.createDataFrame(rows, BOX + ", score double, cls int"), 0.2).collect()

    def iou(a, b):
        w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
        both = max(w, 0) * max(h, 0)
        return both / (800 - both)

    assert kept and all(iou(a, b) <= 0.2 for a in kept for b in kept if a.idx < b.idx)
    p = spark.createDataFrame([(1, 9, 500.0, 500.0, 510.0, 510.0, 1.0), *[(1, k, 0.0, 100.0 * k, 200.0, 100.0 * (k + 1), 1.0) for k in (3, 2, 1, 0)]], "page int, idx int, x1 double, y1 double, x2 double, y2 double, scale double")
    assert {(r.n, r.y2) for r in B.strips(p).collect()} == {(4, 400.0), (1, 510.0)}


def test_glyphs(spark):
    cmap = spark.createDataFrame([("B", 66), ("A", 65), ("A", 97)], "glyph string, codepoint int")
    assert {tuple(r) for r in Y.lowest_code(cmap).collect()} == {("A", 65), ("B", 66)}
    g = spark.createDataFrame([(1, "f", "s1", [0.0, 10.0, 20.0]), (2, "f", "none", [0.0, 0.0, 0.0]), (3, "f", "r9", [9.0, 9.0, 9.0]), (4, "f", "q", [0.0, 10.0, 20.0])], "id long, font string, signature string, pixels array<double>")
    ref = spark.createDataFrame([("f", "r9", 99, [1.0, 1.0, 1.0]), ("f", "a", 97, [0.0, 10.0, 20.0]), ("f", "b", 65, [0.0, 10.0, 20.0]), ("f", "c", 66, [5.0, 10.0, 20.0])], "font string, signature string, codepoint int, pixels array<double>")
    assert {r.id: (r.codepoint, r.method) for r in Y.match_glyphs(g, ref).collect()} == {1: (65, "nearest"), 2: (32, "blank"), 3: (99, "exact"), 4: (65, "nearest")}
    p = spark.createDataFrame([("s", "g", 65, "U+0041", "A"), ("t", "g", 66, "U+0041", "B"), ("u", "g", 67, "U+0043", "D"), ("v", "g", 0x26A26, "U+26A26", "𦨦")], "signature string, glyph string, codepoint int, unicode string, char string")
    assert {r.signature for r in Y.profile_problems(p).collect()} == {"t", "u"}


def test_flags(spark):
    cols = "status string, damage_level int, unknown boolean, unavailable_font boolean, expert_prediction boolean, suspicious boolean, width int, height int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([("damaged", 4, False, False, False, False, 9, 9, 0.0, 0.0, 1.0, 1.0), ("intact", 1, True, False, False, False, 9, 9, 0.0, 0.0, 1.0, 1.0), ("damaged", 2, True, False, False, True, 9, 9, 3.0, 0.0, 1.0, 1.0)], cols).withColumn("k", F.monotonically_increasing_id())
    got = sorted((r.rule for r in V.box_violations(df, ["k"]).collect()))
    assert got == ["bbox", "damage_level", "damage_level", "flags", "flags"]
    n = V.normalized_flags(df).orderBy("k").collect()
    assert n[1].damage_level is None and not n[1].unknown


def test_sources(spark, tmp_path):
    (tmp_path / "Tap-1_x_valid.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "bad.json").write_text('[{"1": {}, "1": {}}]')
    assert [(r.file, r["index"], r.a) for r in readers.read_json_array(spark, str(tmp_path), "a int", "Tap-*.json").orderBy("index").collect()] == [("Tap-1_x_valid.json", 0, 1), ("Tap-1_x_valid.json", 1, 2)]
    assert [r.file for r in readers.duplicate_key_files(spark, str(tmp_path)).collect()] == ["bad.json"]
    names = ["Tap-1_a_VALID.json", "Tap-2_b.json", "Tap-2_b_invalid.json", "Tap-3_c_manual-review.json", "other.json"]
    got = {r.file: (r.prefix, r.kind, r.priority) for r in readers.classify(spark.createDataFrame([(n,) for n in names], "file string")).collect()}
    assert got == {"Tap-1_a_VALID.json": ("Tap-1_a", "valid", 0), "Tap-2_b.json": ("Tap-2_b", "valid", 0), "Tap-3_c_manual-review.json": ("Tap-3_c", "manual-review", 2)}
    (tmp_path / "p").mkdir()
    for n in ("0400.JPG", "b.txt", "c.png"):
        (tmp_path / "p" / n).write_bytes(b"x")
    assert {(r.stem, r.code) for r in readers.list_pictures(spark, str(tmp_path / "p")).collect()} == {("0400", "400"), ("c", "c")}
    cfg = {"title": "^T (?P<number>\\d+)$", "start": "S", "sections": ["S"], "fields": [{"label": "L", "name": "l", "type": "string", "required": False}], "marker": "<(?P<id>\\d+)>(?P<rest>.*)", "consecutive": True, "margins": {"top": 1, "bottom": 2}, "footnote": None}
    assert readers.load_config(json.dumps(cfg)).format.title == "^T (?<number>\\d+)$"
    for wrong in (cfg | {"x": 1}, cfg | {"margins": {"top": -1, "bottom": 0}}, cfg | {"title": "^T$"}):
        with pytest.raises(ValueError):
            readers.load_config(json.dumps(wrong))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "k int, t string").orderBy("k")
    assert sinks.write_json_array(df, tmp_path / "a.json") == 2 and json.loads((tmp_path / "a.json").read_text()) == [{"k": 1, "t": None}, {"k": 2, "t": "é"}]
    sinks.write_csv_bom(df, tmp_path / "a.csv")
    assert (tmp_path / "a.csv").read_bytes() == "﻿k,t\n1,\n2,é\n".encode()
    assert sinks.write_zip({"x": df, "y": df.where("k > 5")}, tmp_path / "a.zip") == {"x": 2, "y": 0}
    assert json.loads(zipfile.ZipFile(tmp_path / "a.zip").read("y.json")) == []
    for bad in ("a�", {"x": ["\u0001"]}):
        with pytest.raises(ValueError):
            sinks.check_text(bad)
    assert sinks.text_problems(spark.createDataFrame([(1, "a\tb"), (2, "a\nb")], "k int, t string"), "k").collect()[0].k == 1
    with pytest.raises(RuntimeError), sinks.replacing(tmp_path / "a.json") as f:
        f.write(b"x")
        raise RuntimeError
    assert (tmp_path / "a.json").read_text().startswith("[") and not list(tmp_path.glob(".a.json*"))
    sinks.swap_if_unchanged(tmp_path / "a.json", json.loads((tmp_path / "a.json").read_text()), {"n": 1})
    with pytest.raises(RuntimeError):
        sinks.swap_if_unchanged(tmp_path / "a.json", {"n": 2}, {})


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema("k int, seq int, v string").parquet(str(src))
        start_latest(s, str(tmp_path / "out"), str(tmp_path / "ck"), "k", ["seq"]).awaitTermination()
    assert {(r.k, r.v) for r in latest_table(spark, str(tmp_path / "out"), "k", ["seq"]).collect()} == {(1, "c"), (2, "b")}


def test_boxes_meet_on_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for cell in (7.0, 64.0):
        a, b = (np.concatenate([np.c_[xy, xy + wh], [[0, 0, 90, 90], [64, 64, 64, 64], [-20, -30, -7, 0], [14, 7, 3, 9]]]) for xy, wh in ((rng.integers(-50, 200, (60, 2)), rng.integers(0, 40, (60, 2))) for _ in range(2)))
        mk = lambda m, p: spark.createDataFrame([(int(k % 2), k, *map(float, r)) for k, r in enumerate(m)] + [(0, 99, None, 0.0, 1.0, 1.0)], f"image int, {p} int, {p}_x1 double, {p}_y1 double, {p}_x2 double, {p}_y2 double")
        got = sorted((r.a, r.b) for r in B.meeting(mk(a, "a"), mk(b, "b"), "image", "a_", "b_", cell).collect())
        want = [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if i % 2 == j % 2 and p[0] <= p[2] and q[0] <= q[2] and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]]
        assert got == want


def test_a_crowded_image_is_joined_cell_by_cell(spark):
    """30 000 boxes of one image: rows compared follow the pairs that meet, where all pairs would be 225 millions."""
    n = 30_000
    k = F.col("id")
    x, y = (k * 7919 % 6000).cast("double"), (k * 104729 % 6000).cast("double")
    boxes = spark.range(n).select(F.lit("i").alias("image"), k.cast("int").alias("idx"), x.alias("x1"), y.alias("y1"), (x + 10 + k % 40).alias("x2"), (y + 10 + k % 31).alias("y2"))
    d, o = (B.prefixed(boxes.where(f"idx % 2 = {m}"), "image", "idx", p) for p, m in (("d", 1), ("o", 0)))
    met = B.meeting(d, o, "image", "d_", "o_")
    rows = boxes.toPandas().to_numpy()[:, 1:].astype(float)
    a, b = rows[1::2], rows[0::2]
    want = sum(int(((b[:, 1] <= r[3]) & (b[:, 3] >= r[1]) & (b[:, 2] <= r[4]) & (b[:, 4] >= r[2])).sum()) for r in a)
    assert met.count() == want
    cells = lambda m: np.concatenate([[(cx, cy) for cx in range(int(r[1] // B.CELL), int(r[3] // B.CELL) + 1) for cy in range(int(r[2] // B.CELL), int(r[4] // B.CELL) + 1)] for r in m])
    compared = sum(np.unique(cells(a), axis=0, return_counts=True)[1].astype(float) ** 2)
    assert compared < n * n / 4 / 200


def test_points_quadrangles_and_unseen_boxes(spark):
    p = spark.createDataFrame([("i", 5.0, 5.0, 1), ("i", 0.0, 0.0, 2), ("i", 9.0, 1.0, 3), ("j", 5.0, 5.0, 4), ("i", None, 1.0, 5)], "image string, x double, y double, k int")
    q = spark.createDataFrame([("i", 0.0, 0.0, 10.0, 5.0, 10.0, 15.0, 0.0, 10.0, "q")], "image string, qx1 double, qy1 double, qx2 double, qy2 double, qx3 double, qy3 double, qx4 double, qy4 double, name string")
    assert sorted((r.k, r.name) for r in B.points_in(p, q, "image").collect()) == [(1, "q"), (2, "q")]
    mk = lambda rows: spark.createDataFrame([("i", k, *map(float, r)) for k, r in enumerate(rows)], BOX)
    first = mk([(0, 0, 10, 10), (20, 0, 30, 10), (50, 50, 60, 60), (100, 0, 101, 1)])
    assert [r.idx for r in B.unseen(first, mk([(1, 1, 10, 10), (24, 4, 26, 6), (57, 50, 67, 60), (101, 1, 102, 2)])).orderBy("idx").collect()] == [2]


def test_anchored_rows(spark):
    chips = [(1, 0.0, 10.0, 30.0), (2, 0.0, 18.0, 38.0), (3, 5.0, 1.0, 21.0), (4, 1.0, 11.5, 20.0), (5, 0.0, 60.0, 64.0), (6, 0.0, 53.0, 57.0), (7, 0.0, 46.0, 50.0)]
    got = B.anchored_rows(spark.createDataFrame([("g", *c) for c in chips], "g string, idx int, left double, top double, bottom double"), "g").collect()
    # the fourth is near the first row's own top, but that has moved up; the last is near the sixth, whose row took its top along
    rows, at = [], {}
    for i, _, top, bottom in chips:
        hit = next((r for r in rows if abs(r[0] - top) < max(8, (bottom - top) / 2)), None)
        if hit is None:
            rows.append(hit := [top, []])
        hit[0] = min(hit[0], top)
        hit[1].append(i)
    for n, r in enumerate(sorted(rows, key=lambda r: r[0]), 1):
        for place, i in enumerate(sorted(r[1], key=lambda i: chips[i - 1][1]), 1):
            at[i] = n, place
    assert {r.idx: (r.row, r.place) for r in got} == at and len(rows) == 3
