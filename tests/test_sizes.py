"""Faults that only larger tables show, on small ones."""

from pyspark.sql import functions as F

from lithos.operators import analytics as A
from lithos.operators import boxes as B
from lithos.operators import display as D
from lithos.operators import missing as M
from lithos.operators import reading
from lithos.operators import relational as R
from lithos.operators import segment as S
from lithos.plans import boxes as Q
from lithos.plans import pages as P

SF = "/root/testdata/sf0.001"


def test_places_beyond_page_2147(spark):
    lines = spark.createDataFrame([(1, 1, "BIA 1", 5000, 50.0), (1, 2, "Ids: 7", 5000, 60.0)], "volume int, line_no int, text string, page_number int, y0 double")
    (r,) = M.inscriptions(lines, "^BIA", "^Ids: ", 100_000).collect()
    assert (r.ids, r.start, r.end) == (["7"], 5000 * M.PAGE + 5000, 100_001 * M.PAGE)


def test_picture_plan_beyond_record_2147(spark, tmp_path):
    n = 25_000  # 2500 records a volume
    spark.range(1, n + 1).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    line = spark.range(1, n + 1).select(F.col("id").alias("l_orderkey"), F.explode(F.array(F.lit(1), F.lit(2))).alias("l_linenumber"))
    line.select("*", F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(1.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([("A",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    rows = {(r.id, r.unread): (r.status, r.page, r.idx) for r in P.picture_plan(spark, str(tmp_path)).where("id in ('24993', '24990')").collect()}
    assert rows == {("24993", False): ("planned", 2500, 1), ("24993", True): ("needs_review", None, None), ("24990", False): ("needs_review", None, None), ("24990", True): ("needs_review", None, None)}


def test_fonts_without_broadcast(spark):
    chars = spark.createDataFrame([(1, 1, i, "n", 10.0 + i, 5.0, 65 + i) for i in range(3)], "page int, span int, pos int, name string, x double, y double, code int")
    runs = spark.createDataFrame([(1, 1, "n", "a", 10.0, 5.0, [65, 66, 9]), (1, 2, "n", "b", 0.0, 5.01, [1, 66, 67])], "page int, run int, name string, font string, x double, y double, codes array<int>")
    got = D.assign_fonts(chars, runs, runs.select("page", "name", "font"))
    assert [(r.pos, r.font) for r in got.orderBy("pos").collect()] == [(0, "a"), (1, "a"), (2, "b")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_multisets_without_interpreted_order(spark):
    d = spark.createDataFrame([(["b", None, "a"], ["a", "b", None]), (["a", "a"], ["a"]), (None, ["a"])], "a array<string>, b array<string>").select(R.same_multiset(F.col("a"), F.col("b")).alias("same"))
    assert [r.same for r in d.collect()] == [True, False, None]
    assert "lambda" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_terms_cross_the_network_once(spark):
    docs = spark.createDataFrame([("a", 1, "x y x"), ("a", 1, "y"), ("a", 2, "x")], "lang string, doc_id int, text string")
    got = A.document_terms(docs)
    assert {(r.doc, r.term): r.n for r in got.collect()} == {(1, "x"): 2, (1, "y"): 2, (1, None): 0, (2, "x"): 1, (2, None): 0}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(volume#" in plan and ", term#" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]


def exchanges(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_boxes_are_dealt_once(spark):
    assert len(exchanges(Q.nms_greedy(spark, SF))) == 2 and len(exchanges(Q.reading_order_full(spark, SF))) == 1


def test_nms_over_batches(spark):
    rows = [(g, i, 0, float(i), 0.0, i + 10.0, 10.0, s) for g in range(30) for i, s in enumerate((0.5, 0.9, 0.4, 0.9))]
    boxes = spark.createDataFrame(rows, "image int, idx int, cls int, x1 double, y1 double, x2 double, y2 double, score double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted((r.image, r.idx) for r in B.nms(boxes, 0.9).collect()) == [(g, i) for g in range(30) for i in range(4)]
        assert sorted((r.image, r.idx) for r in B.nms(boxes, 0.75).collect()) == [(g, i) for g in range(30) for i in (1, 3)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_positions_are_not_dealt(spark):
    assert not any("pos#" in x for x in exchanges(Q.align_positional(spark, SF)))
    rows = spark.createDataFrame([(1, ["a", "b"], [7]), (2, None, [8, 9]), (3, ["c"], None), (4, None, None)], "item int, tokens array<string>, boxes array<int>")
    assert sorted(map(tuple, R.align_rows(rows, "item").collect()), key=lambda r: r[:2]) == [(1, 1, "a", 7, False), (1, 2, "b", None, True), (2, 1, None, 8, False), (2, 2, None, 9, False), (3, 1, "c", None, True)]


def test_issues_in_one_pass_without_details(spark):
    fmt = S.RecordFormat(title="^R ([0-9]+)$", start="Text", sections=(), fields=(S.Field("Ids:", "ids", "identifiers", True),))
    lines = spark.createDataFrame([("v", i, t, 1) for i, t in enumerate(("R 1", "stray", "Ids: <7>", "Text", "loose", "<7>", "- x", "R 2", "x"))], "volume string, line_no int, text string, page_number int")
    whole, bare = (S.parse_records(lines, fmt, d) for d in (True, False))
    kinds = lambda df: [(r.rec, r.errors, [w.kind for w in r.warnings]) for r in df.orderBy("rec").collect()]
    assert kinds(whole) == kinds(bare) == [(1, [], ["before_metadata", "unmarked_content"]), (2, ["missing heading Text"], ["before_metadata"])]
    assert all(w.detail is None for r in bare.collect() for w in r.warnings) and all(w.detail for r in whole.collect() for w in r.warnings)
    assert "Union\n" not in S.record_issues(whole.localCheckpoint())._jdf.queryExecution().executedPlan().toString()


def test_contents_are_dealt_before_they_are_searched(spark):
    page = "1 0 0 1 5 7 Tm /F1 9 Tf [<0041 00\n42>-20 <0043>] TJ 1 0 0 1 5 7.0 Tm\n/F1 9 Tf <004100420043> Tj 1 0 0 1 1 2 Tm /F9 9 Tf <0041> Tj 1 0 0 1 3 4 Tm /F2 9 Tf <004> Tj"
    streams = spark.createDataFrame([(1, page), (2, None), (None, page)], "page int, content string").coalesce(1)
    fonts = spark.createDataFrame([(1, "F1", "n", "a"), (1, "F1", "m", "b"), (1, "F2", "n", "c"), (2, "F1", "n", "a"), (None, "F1", "n", "a")], "page int, resource string, name string, font string")
    got = D.font_runs(streams, fonts)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "m", "b", 5.0, 7.0, [65, 66, 67]), (1, 0, "n", "a", 5.0, 7.0, [65, 66, 67])]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = exchanges(got)
    assert "Broadcast" not in plan and dealt and not any("resource#" in x or "codes#" in x for x in dealt)
    assert plan.index("regexp_extract_all(content#") < plan.index("REPARTITION_BY_COL") and plan.count("regexp_extract_all(content#") == 1


def test_fusion_meets_once(spark):
    rows = lambda *b: spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(b)] + [(None, 0, 0.0, 0.0, 9.0, 9.0), (2, 0, None, 0.0, 9.0, 9.0)], "image int, idx int, x1 double, y1 double, x2 double, y2 double")
    # one text box goes by its share alone, though a second damage box lies in it; two damage boxes become one text box, the first of equal ones
    damage = rows((0, 0, 10, 10), (1, 1, 3, 3), (21, 21, 23, 23), (22, 22, 24, 24), (50, 50, 51, 51))
    text = rows((0, 0, 10, 11), (20, 20, 30, 30), (20, 20, 30, 30), (70, 70, 80, 80))
    got = B.fuse(damage, text)
    assert sorted((r.status, r.idx, r.x1) for r in got.where("image = 1").collect()) == [("damaged", 0, 0.0), ("damaged", 1, 1.0), ("damaged", 2, 20.0), ("damaged", 4, 50.0), ("intact", 2, 20.0), ("intact", 3, 70.0)]
    assert sorted((str(r.image), r.status, r.x1) for r in got.where("image is null or image = 2").collect()) == [("2", "damaged", None), ("2", "intact", None), ("None", "damaged", 0.0), ("None", "intact", 0.0)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len([x for x in plan.split("\n") if "Join" in x and "__cx" in x]) == 1


def test_order_draws_no_needless_rectangles(spark, monkeypatch):
    drawn, rectangle = [], reading.rectangle
    monkeypatch.setattr(reading, "rectangle", lambda boxes: drawn.append(len(boxes)) or rectangle(boxes))
    assert reading.reading_order([(0.0, 0.0, 9.0, 9.0)]) == [0] and reading.double_lines([(0, 9, 9, 19), (0, 0, 9, 9)], [1, 0]) == [1, 0] and not drawn
    # upright sides after the first give the same rectangle, so only slanted ones are tried besides
    assert reading.corners_of((0, 0, 8, 0, 8, 4, 0, 4)) == reading.hull({(0, 0), (8, 0), (8, 4), (0, 4)})
    monkeypatch.undo()
    rows = [(g, i, 20.0 * i, 0.0, 20.0 * i + 9, 9.0) for g in (1, 2, 3) for i in range(g)]
    boxes = spark.createDataFrame(rows, "image int, idx int, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    assert sorted((r.image, r.idx, r.reading_pos) for r in reading.full_order(boxes).collect()) == [(g, i, g - i) for g in (1, 2, 3) for i in range(g)]


def test_points_meet_spans_by_many_tasks(spark):
    got = Q.range_join_intervals(spark, SF)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and len(exchanges(got)) == 2


def test_volumes_are_dealt_by_blocks(spark):
    b = R.BLOCK
    rows = [(v, n, t) for v in ("v", "w", None) for n, t in ((b - 3, "stray"), (b - 2, "T 1"), (b - 1, "Ids: 5 /"), (b, " 06,"), (b + 1, None), (b + 2, "7"), (3 * b, "T 2"), (9 * b, "T 3"), (9 * b + 1, "Ids: 8"))]
    lines = spark.createDataFrame([(*r, 1 + r[1] // b, 2.0) for r in rows], "volume string, line_no int, text string, page_number int, y0 double")
    got = M.inscriptions(lines, "^T ", "^Ids: ", 99)
    # by volume alone goes only what the blocks sum up to; lines go by block, then by record
    dealt = [x.split("hashpartitioning(")[1].split(", ENSURE")[0] for x in exchanges(got)]
    assert sum(x.count("#") == 1 for x in dealt) == 1 and any("__block#" in x for x in dealt) and any("rec#" in x for x in dealt)
    at = lambda page: page * M.PAGE + 200
    want = [(1, ["5", "6"], at(1), at(4)), (2, [], at(4), at(10)), (3, ["8"], at(10), 100 * M.PAGE)]
    assert sorted(((str(r.volume), r.rec, r.ids, r.start, r.end) for r in got.collect())) == [(v, *w) for v in ("None", "v", "w") for w in want]


def test_sums_run_over_blocks(spark):
    rows = [(g, n, None if n == 4 else n % 3) for g in (1, 2, None) for n in (*range(-5, 20), 5000)]
    got = R.running_sum(spark.createDataFrame(rows, "g int, n int, v int"), "g", "n", "v", 4)
    assert sorted((str(r.g), r.n, r.so_far) for r in got.collect()) == sorted((str(g), n, sum(b or 0 for a, m, b in rows if a == g and m <= n)) for g, n, _ in rows)


def test_pairs_of_one_place_lie_together(spark):
    n = 2 * R.PACK + 40
    points = spark.createDataFrame([(i % 3 if i else None, i, i % 4) for i in range(2 * n)] + [(1, None, 2), (1, 7, None)], "g int, id int, at int").coalesce(1)
    spans = spark.createDataFrame([(1, 0, i, 0, 4) for i in range(n)] + [(1, 1, n, 2, 3), (1, 2, n, 3, 3), (None, 3, n, 0, 4), (2, 4, n, -9, 500)], "g int, kind int, span int, start int, end int")
    got = [tuple(r) for r in R.interval_join(points, spans, "g", 200).collect()]
    want = [(g, i, at, k, s, a, e) for g, i, at in map(tuple, points.collect()) for h, k, s, a, e in map(tuple, spans.collect()) if g is not None and g == h and at is not None and a <= at < e]
    order = lambda r: [-1 if v is None else v for v in r]
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) > n * n // 2
    # places change no more often than packed points meet packed spans
    assert sum(a[2] != b[2] or a[0] != b[0] for a, b in zip(got, got[1:])) < 4 * 3 * 4 + 8
