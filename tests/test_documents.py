"""Project files, strict parsing, payloads and leaves, by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from lithos.operators import documents as C
from lithos.operators import records as N
from lithos.operators import segment as S
from lithos.sources import readers

PROJECT = {
    "input_pdf_path": "../a.pdf",
    "paths": {"output_json": "o.json", "glyph_profile": "/g.json"},
    "encoded_fonts": {"Times": "t.ttf", "Times,Bold": "b.ttf"},
    "page_filter": {"margins": {"top": 40.0, "bottom": 45}, "footnotes": {"start_pattern": "^\\d+\\s+", "max_font_size": 10.0}},
    "records": {
        "title_pattern": "^RECORD (?P<number>\\d+)$", "metadata": [{"label": "Name", "field": "name", "type": "string", "required": False}],
        "content": {"start_heading": "Text", "section_headings": ["Text"]}, "face_marker_pattern": "^<(?P<id>\\d+)>(?P<rest>.*)$", "require_consecutive_numbers": True,
    },
}


def changed(path, value):
    d = json.loads(json.dumps(PROJECT))
    at = d
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(d)


def test_project():
    p = readers.load_project(json.dumps(PROJECT), "/x/y")
    assert p.files["input_pdf_path"] == "/x/a.pdf" and p.files["glyph_profile"] == "/g.json" and p.fonts["Times"] == "/x/y/t.ttf"
    assert p.volume.top == 40 and p.volume.footnote_size == 10 and p.volume.format.title == "^RECORD (?<number>\\d+)$" and not p.show_metadata
    assert readers.load_project(changed(("page_filter", "footnotes"), None), "/").volume.footnote is None
    shown = {"image_dir": "i", "output_dir": "o", "show_metadata_fields": True}
    assert readers.load_project(changed(("gradio",), shown), "/").show_metadata


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("paths", "output_json"), KeyError), (("paths", "other"), "x"), (("page_filter", "margins", "top"), -1), (("page_filter", "margins", "top"), True), (("page_filter", "footnotes", "max_font_size"), 0),
        (("page_filter", "footnotes", "start_pattern"), "("), (("records", "title_pattern"), "^(\\d+)$"), (("records", "require_consecutive_numbers"), 1), (("records", "metadata"), []), (("input_pdf_path",), " "),
        (("records", "metadata", 0, "type"), "number"), (("records", "metadata", 0, "field"), "noi_dung"), (("encoded_fonts", "TIMES-bold"), "x"), (("stale",), 1), (("records", "content", "section_headings"), [""]), (("gradio",), {"image_dir": "i"}),
    ],
)
def test_bad_project(path, value):
    with pytest.raises(ValueError):
        readers.load_project(changed(path, value), "/")


def test_strict(spark):
    fmt = S.RecordFormat("^RECORD (\\d+)$", "Text", ("Text",), (S.Field("Name", "name"), S.Field("Ids", "ids", "identifiers", True)))
    rows = lambda *texts: spark.createDataFrame([(1, i, t, 1) for i, t in enumerate(texts)], "volume int, line_no int, text string, page_number int")
    good = ("RECORD 1", "Name: a", "Ids: <12>", "Text", "<12>", "x")
    assert S.parse_strict(rows(*good), fmt).count() == 1
    with pytest.raises(S.ParseError, match="missing metadata Ids"):
        S.parse_strict(rows(*good, "RECORD 2", "Name: b", "Text", "x"), fmt)
    with pytest.raises(S.ParseError, match="repeated numbers"):
        S.parse_strict(rows(*good, "RECORD 1", "Name: b", "Text", "x"), fmt)


def test_payload():
    assert C.payload_problem("status", None) is None and C.payload_problem("status", '{"statuses": []}') == "statuses"
    assert C.payload_problem("crop", '{"crop": {"bbox": [1, 2, 3, 4]}}') == "crop" and C.payload_problem("boxes", "1") == "json"


def plain_leaves(value, path="$"):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain_leaves(v, f"{path}[{i}]")]
    return [(path, value if value is None or isinstance(value, str) else json.dumps(value))]


def test_leaves(spark):
    texts = ['{"b": {"x": [1.5, [true, null]]}, "a": "q", "e": [], "o": {}}', None, "7", "null", "[]", '[[[[["deep"]]]], {"k[0].x": "}{[\\\\", "\\"]": "\\\\"}]', '{"漢": {"é": [[], {}, [{}], "\\u00e9", -0.5, 12345678901]}}']
    d = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {}
    for r in N.tree_leaves(d, "j").collect():
        got.setdefault(r.i, []).append((r.path, r.value))
    want = {i: plain_leaves(json.loads(t)) for i, t in enumerate(texts) if t is not None}
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items() if v}
    deep = lambda v: 1 + max(map(deep, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, (dict, list)) else 0
    assert [r.d for r in d.orderBy("i").select(N.json_depth(F.col("j")).alias("d")).collect()] == [None if t is None else deep(json.loads(t)) for t in texts]
    plan = N.tree_leaves(d, "j")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    for bad in ('{"a": {"b": 1, "b": 2}}', '{"a": '):
        with pytest.raises(Exception):  # noqa: B017
            N.tree_leaves(spark.createDataFrame([(1, bad)], "i int, j string"), "j").collect()
