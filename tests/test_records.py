"""Record parser, text functions and key operators on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from lithos.functions import text as T
from lithos.operators import analytics as A
from lithos.operators import missing as M
from lithos.operators import records as N
from lithos.operators import relational as R
from lithos.operators import segment as S

START = "Nguyên văn chữ Hán Nôm"
FMT = S.RecordFormat(
    "^VĂN BIA SỐ\\s+(?<number>\\d+)\\s*$", START, (START, "Phiên âm Hán Việt", "Dịch nghĩa", "Toát yếu", "Chú thích"),
    (S.Field("Tên bia", "ten_bia"), S.Field("Địa điểm", "dia_diem"), S.Field("Niên đại", "nien_dai", required=True), S.Field("Kí hiệu VNCHN", "ids", "identifiers", True)),
)
SUFFIX = S.RecordFormat(FMT.title, FMT.start, FMT.sections, FMT.fields, "^\\s*<\\s*(\\d+[A-Za-z]?)\\s*>?\\s*(.*)$")


def lines(spark, texts, page=1, volume=1):
    pages = page if isinstance(page, list) else [page] * len(texts)
    return spark.createDataFrame([(volume, i, t, p) for i, (t, p) in enumerate(zip(texts, pages, strict=True))], "volume int, line_no int, text string, page_number int")


def parse(spark, texts, page=1, fmt=FMT):
    return S.parse_records(lines(spark, texts, page), fmt)


FULL = [
    "VĂN BIA SỐ 1", "Tên bia: Bia chùa", "Địa điểm: xã", "Đông", "Niên đại: Vĩnh Tộ 10 (1628)", "Kí hiệu VNCHN: <4349><4350><4351>", START,
    "<4349>", "永寺", "<4350 樂文", "Phiên âm Hán Việt", "<4349> Vĩnh tự", "<4350> Phiên âm hai", "Dịch nghĩa", "<4349>", "nghĩa",
]


def test_full_record(spark):
    r = parse(spark, FULL).collect()[0]
    assert r.ids == ["4349", "4350", "4351"]
    assert [f.id for f in r.faces] == ["4349", "4350", "4351"]
    assert r.metadata["dia_diem"] == "xã Đông" and r.metadata["nien_dai"] == "Vĩnh Tộ 10 (1628)"
    assert [(s.title, s.text) for s in r.faces[0].sections] == [(START, "永寺"), ("Phiên âm Hán Việt", "Vĩnh tự"), ("Dịch nghĩa", "nghĩa")]
    assert r.faces[1].sections[0].text == "樂文"
    assert len(r.errors) == 1 and "<4351>" in r.errors[0]
    assert [(w.kind, w.face) for w in r.warnings] == [("empty_marker", "4351")]


def test_unmarked_and_unknown(spark):
    head = ["VĂN BIA SỐ 1", "Niên đại: x", "Kí hiệu VNCHN: 10"]
    r = parse(spark, [*head, START, "lạc", "<10> 甲"], [1, 1, 1, 1, 3, 3]).collect()[0]
    assert r.faces[-1].id is None and r.faces[-1].sections[0].text == "lạc"
    assert [(w.kind, w.page) for w in r.warnings] == [("unmarked_content", 3)]
    r = parse(spark, [*head, START, "<10> 甲", "<11> 乙"], 7).collect()[0]
    w = r.warnings[0]
    assert (w.kind, w.page, w.face, w.detail) == ("unknown_marker", 7, "11", "<11> 乙")


def test_label_variants(spark):
    r = parse(spark, ["VĂN BIA SỐ 2", "Ðịa điểm: A", "Niên đại: x", "Ký hiệu: N°12940/12941", "Nguyên văn chữ Hán:", "<12940> 甲", "Phiên âm:", "<12940> a"]).collect()[0]
    assert r.metadata["dia_diem"] == "A" and r.ids == ["12940", "12941"]
    assert [s.title for s in r.faces[0].sections] == [START, "Phiên âm Hán Việt"]


def test_isolation_sequence_and_split(spark):
    bad = ["VĂN BIA SỐ 1", "Niên đại: x", "Kí hiệu VNCHN: 1"]
    good = ["VĂN BIA SỐ 3", "Niên đại: x", "Kí hiệu VNCHN: 0400", START, "<400> 甲"]
    r = parse(spark, bad + good, [3] * 3 + [4] * 5)
    rows = r.orderBy("rec").collect()
    assert rows[0].faces is None and "missing heading" in rows[0].errors[0] and rows[0].pages == [3] and rows[0].lines == bad
    assert rows[1].faces[0].id == "0400" and rows[1].errors == []  # a marker matches without leading zeros
    primary, issues = S.split_output(r, FMT)
    assert [x.number for x in primary.collect()] == [3]
    assert {x.number for x in issues.collect()} == {1, None}
    assert S.parse_records(lines(spark, ["nothing"]), FMT).count() == 0


def test_suffix_ids(spark):
    r = parse(spark, ["VĂN BIA SỐ 1", "Niên đại: x", "Kí hiệu VNCHN: <33651a><33651b>", START, "<33651a> 甲", "<33651b> 乙"], fmt=SUFFIX).collect()[0]
    assert [(f.id, f.sections[0].text) for f in r.faces] == [("33651a", "甲"), ("33651b", "乙")]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (T.clean_line, "A\u0001B�", "AB"), (T.clean_line, " a  b ", "a b"), (T.identifiers, "8460/8461; N°12940/12941", ["8460", "8461", "12940", "12941"]),
        (T.label_key, "Ký  Hiệu Đ", "ki hieu d"), (T.segments, "ÐIỀN\nđiền, hậu [] thần □ xã… dân 123 thôn 漢 phật", [["điền", "điền"], ["hậu"], ["thần"], ["xã"], ["dân"], ["thôn"], ["phật"]]),
        (T.segments, "Bản xã\nToát yếu: thôi", [["bản", "xã"]]), (T.annotation_text, " 永、樂。寺\n(𨴦) @", "永樂寺𨴦@"), (lambda c: F.size(T.graphemes(c)), "á𨴦︀", 2),
        (T.years, "năm 1628, 1628 và 21628 x1700", [1628]), (T.normalize_key, " 0400 ", "400"), (T.normalize_key, "000", "0"), (T.normalize_key, "  ", None), (T.hex_codes, "0041 00e9", [65, 233]), (T.hex_codes, "004", []),
        (T.font_key, "ABCDEF+Palatino Linotype,Bold", "palatinolinotypebold"), (lambda c: T.layout(c, "space", True), "Dòng một\\\nhai", "Dòng một hai"),
    ],
)
def test_text(spark, f, x, y):
    assert one(spark, f, x) == y


def test_frequency(spark):
    docs = spark.createDataFrame([(1, 1, "Bản xã bản xã. Hậu thần"), (1, 2, "Bản xã\nToát yếu: x"), (1, 3, "[]"), (1, 4, None)], "lang int, doc_id int, text string")
    f = {r.term: r for r in A.frequency(docs).collect()}
    assert f["bản"]["count"] == 3 and f["bản"].inscription_count == 2 and f["bản"].frequency_pct == 37.5 and f["bản"].inscription_pct == 100
    p = {r.term: r["count"] for r in A.frequency(docs, "pairs").collect()}
    assert p["bản xã"] == 3 and "xã hậu" not in p
    s = A.volume_summary(docs).first()
    assert (s.valid, s.missing, s.contaminated) == (2, 1, 1) or (s.valid, s.missing, s.contaminated) == (2, 2, 1)
    many = spark.createDataFrame([(1, i, "bản xã") for i in range(20)] + [(1, 100 + i, "hậu thần") for i in range(19)], "lang int, doc_id int, text string")
    assert A.rare_terms(A.frequency(many)).first().rare_types == 2 and A.rare_terms(A.frequency(many, "pairs")).first().rare_types == 1


def test_lookup_and_winner(spark):
    images = spark.createDataFrame([("0400",), ("7",), ("x",)], "image_code string")
    faces = spark.createDataFrame([("400",), ("07",), ("x",), ("x",)], "face_key string")
    got = {r.image_code: (r.matched, r.match_count) for r in R.lookup(images, faces).collect()}
    assert got == {"0400": ("400", 1), "7": (None, 0), "x": ("x", 2)}
    f = spark.createDataFrame([("v", "a", 0, 1, 10, 1), ("v", "a", 2, 2, 11, 2), ("v", "b", 2, 3, 11, 2), ("v", "a", 2, 4, 12, None)], "volume string, face_key string, priority int, seq int, record_id int, number int")
    won = R.merge_faces(f)
    assert {(r.face_key, r.seq, r.first_seq) for r in won.collect()} == {("a", 4, 1), ("b", 3, 3)}
    assert [(r.record_id, r.faces) for r in R.regroup(won).orderBy("position").collect()] == [(11, ["b"]), (12, ["a"])]


def test_align(spark):
    tok = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate("永寺樂")], "image int, pos int, token string")
    box = spark.createDataFrame([(1, i + 1, i) for i in range(5)], "image int, pos int, box int")
    assert [r.token for r in R.align_missing(tok, box, "image").orderBy("pos").collect()] == ["永", "寺", "樂", "MISS", "MISS"]
    assert [r.token for r in R.align(tok, box.where("pos <= 2"), "image").where("excluded").collect()] == ["樂"]


def test_planner(spark):
    l = spark.createDataFrame(  # noqa: E741
        [(1, 1, "BIA 1", 1, 50.0), (1, 2, "Ký hiệu: 55432/", 1, 60.0), (1, 3, "55431.", 1, 70.0), (1, 4, "<22695>", 1, 80.0), (1, 5, "BIA 2", 4, 80.0), (1, 6, "Ký hiệu: 10/11", 4, 90.0)],
        "volume int, line_no int, text string, page_number int, y0 double",
    )
    rec = M.inscriptions(l, "^BIA", "^Ký hiệu:", 6).orderBy("rec").collect()
    assert [r.ids for r in rec] == [["55432", "55431"], ["10", "11"]]
    assert rec[0].end == 4 * M.PAGE + 8000 and rec[1].end == 7 * M.PAGE
    df = M.inscriptions(l, "^BIA", "^Ký hiệu:", 6)
    want = spark.createDataFrame([("55431",), ("10",), ("99",)], "id string")
    pics = spark.createDataFrame([(1, 1, 2, 10.0), (1, 2, 3, 10.0), (1, 3, 5, 10.0)], "volume int, idx int, page int, y0 double")
    assert {r.id: (r.status, r.page) for r in M.plan(want, df, pics).collect()} == {"55431": ("planned", 3), "10": ("needs_review", None), "99": ("not_found", None)}
    report = spark.createDataFrame([(["00012"], [(["12", "131335"],)])], "missing_ids array<string>, groups array<struct<missing_ids: array<string>>>")
    assert {r.id for r in M.requested(report).collect()} == {"12", "131335"}


def test_content(spark):
    f = spark.createDataFrame([("a", None, [("X", None), ("Y", "y")])], "image string, ten_bia string, sections array<struct<title: string, text: string>>")
    r = N.completed(f, ["X", "Z"], ["ten_bia"]).first()
    assert r.ten_bia == "" and [(s.title, s.text) for s in r.sections] == [("X", ""), ("Y", "y"), ("Z", "")]
    assert [(x.label, x.value) for x in N.content_fields(f, ["image"], ["Y", "X"], {"ten_bia": "Tên bia"}).orderBy("pos").collect()] == [("Tên bia", ""), ("Y", "y"), ("X", "")]
    assert f.select(N.edited(F.col("sections"), "Y", "z").alias("s")).first().s[1].text == "z"


def test_decades(spark):
    d = spark.createDataFrame([(1628,), (1655,), (None,)], "year int")
    assert [(r.decade_start, r["count"]) for r in A.decades(d).orderBy("decade_start").collect()] == [(1620, 1), (1630, 0), (1640, 0), (1650, 1)]
    y = A.with_years(spark.createDataFrame([("1628 1700",), ("x",)], "t string"), "t", "exclude").collect()
    assert [(r.status, r.year) for r in y] == [("multiple_years", None), ("missing_year", None)]


def test_planner_odds(spark):
    """Repeated ids, unread volumes, pictures that reach into the next record, ids that go on after blank lines, and a record whose pages are known."""
    text = ["BIA 1", "Ký hiệu:", "  ", "7, 7 ;", "x", "Ký hiệu: 99", "BIA 2", "Ký hiệu: 8 –", "9"]
    l = spark.createDataFrame([(1, i, t, 1 + (i > 5), 50.0 + i) for i, t in enumerate(text)], "volume int, line_no int, text string, page_number int, y0 double")  # noqa: E741
    records = M.inscriptions(l, "^BIA [0-9]+$", "^Ký hiệu: ?", 3)
    assert {r.rec: r.ids for r in records.collect()} == {1: ["7", "7"], 2: ["8"]}
    pics = spark.createDataFrame([(1, 1, 1, 60.0, 70.0), (1, 2, 1, 80.0, 90.0), (1, 3, 2, 10.0, 56.5), (1, 4, 2, 57.0, 99.0)], "volume int, idx int, page int, y0 double, y1 double")
    assert sorted((r.rec, r.pos, r.idx) for r in M.faces_of(records, pics).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 4)]
    want = spark.createDataFrame([("7",), ("8",), ("8",), ("5",)], "id string")
    plan = lambda **more: {r.id: (r.status, r.idx) for r in M.plan(want, records, pics, **more).collect()}
    assert plan() == {"7": ("needs_review", None), "8": ("planned", 4), "5": ("not_found", None)}
    errors = spark.createDataFrame([("tap_4",)], "config string")
    over = spark.createDataFrame([("5", 9, 2)], "id string, page int, idx int")
    assert plan(errors=errors.where("false"), overrides=over)["5"] == ("planned", 2)
    assert plan(errors=errors, overrides=over) == {"7": ("needs_review", None), "8": ("needs_review", None), "5": ("needs_review", None)}
    assert sorted(map(tuple, M.plan_record(["7", "7"], records, pics, (1, 1)).collect())) == [("7", 1, 1), ("7", 1, 2)]
    for ids, pages, why in ((["7", "7"], (1, 2), "4 pictures"), (["1"], (1, 1), "0 records")):
        with pytest.raises(Exception, match=why):
            M.plan_record(ids, records, pics, pages).collect()


def test_ranges_and_report(spark):
    d = spark.createDataFrame([("a", n) for n in (3, 1, 2, 7, 7)] + [("b", n) for n in (1, 3, 5, 6, 9, 11)] + [("c", n) for n in (1, 3, 5, 8)], "g string, n int")
    assert {r.g: r.ranges for r in R.ranges_text(d, "g", "n").collect()} == {"a": "1–3, 7", "b": "1, 3, …, 9, 11", "c": "1, 3, 5, 8"}
    records = spark.createDataFrame([("v",), ("v",), ("w",)], "volume string")
    issues = spark.createDataFrame([("v", 5, ["lacks Text"]), ("v", 5, ["other"]), ("v", 2, ["other", "it lacks Text here"]), ("v", None, ["lacks Text"]), ("v", 9, []), ("u", 1, ["x"])], "volume string, number int, errors array<string>")
    got = {r.volume: tuple(r)[1:] for r in A.extraction_report(records, issues, "lacks Text").collect()}
    assert got == {"v": (4, 2, 2, [2, 5], [2, 5], 1), "w": (1, 1, 0, [], [], 0), "u": (1, 0, 1, [1], [], 0)}
