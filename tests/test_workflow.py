"""Sessions of actions, displayed tokens and fonts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import display as D
from lithos.operators import workflow as W


def go(*actions, text="永寺樂"):
    s = W.start(100, 100)
    for name, payload in (("save_content", {"text": text}), *actions):
        s = W.apply(s, name, payload)
    return s


THREE = ("detect", {"boxes": [[0, 0, 9, 9], [0, 10, 9, 19], [0, 20, 9, 29]], "damaged": 1})


def test_session():
    s = go(THREE, ("sort_boxes", {"order": [2, 3, 1]}), ("next", {}))
    assert s["step"] == W.STATUS and s["tokens"] == list("永寺樂") and s["revision"] == 4
    with pytest.raises(W.Rejected, match="level"):
        W.apply(s, "next", {})
    for bad in (True, 0, 4, "2", 2.0):
        with pytest.raises(W.Rejected):
            W.apply(s, "statuses", {"ids": [1], "damaged": True, "level": bad})
    s = W.apply(s, "statuses", {"ids": [1], "damaged": True, "level": 2})
    s = W.apply(W.apply(W.apply(s, "next", {}), "crop", {"bbox": [0, 0, 50, 50]}), "next", {})
    assert W.apply(s, "save", {}, s["revision"])["saved"]
    with pytest.raises(W.Rejected, match="revision"):
        W.apply(s, "save", {}, 1)


def test_mismatch_and_edits():
    s = go(("detect", {"boxes": [[0, 0, 9, 9 + i] for i in range(5)]}))
    with pytest.raises(W.Rejected, match="counts"):
        W.apply(s, "next", {})
    s = W.apply(W.apply(s, "confirm_source_mismatch", {"kind": "missing_text"}), "sort_boxes", {"order": [1, 2, 3, 4, 5]})
    assert W.apply(s, "next", {})["tokens"] == ["永", "寺", "樂", "MISS", "MISS"]
    with pytest.raises(W.Rejected, match="note"):
        W.apply(s, "confirm_source_mismatch", {"kind": "other", "note": " "})
    s = W.apply(s, "delete", {"ids": [2, 2]})
    assert sorted(s["boxes"]) == ["1", "2", "3", "4"] and s["order"] == [] and s["mismatch"] is None
    for b in ([5, 0, 4, 9], [-1, 0, 4, 9], [0, 0, 101, 9], [float("nan"), 0, 4, 9]):
        with pytest.raises((W.Rejected, ValueError)):
            W.apply(s, "add", {"bbox": b})


def test_replay(spark):
    log = [("a", 1, "save_content", {"text": "永"}, None), ("a", 2, "next", {}, None), ("a", 3, "detect", {"boxes": [[0, 0, 1, 1]]}, 1), ("a", 4, "add", {"bbox": [0, 0, 2, 2]}, 0), ("b", 1, "zzz", {}, None)]
    df = spark.createDataFrame([(s, q, a, json.dumps(p), r, 10, 10) for s, q, a, p, r in log], "session string, seq long, action string, payload string, revision int, width int, height int")
    r = W.replay(df)
    assert {(x.session, x.seq): x.reason for x in r.collect()} == {("a", 1): None, ("a", 2): "boxes", ("a", 3): None, ("a", 4): "revision", ("b", 1): "action"}
    assert json.loads(W.final_states(r).where("session = 'a'").first().state)["revision"] == 2


def test_display(spark):
    ch = spark.createDataFrame([(1, i, c, y, y + 10.0) for i, (c, y) in enumerate((("永", 0.0), ("寺", 11.0), ("樂", 40.0)))], "line int, pos int, char string, y1 double, y2 double")
    assert D.spaced_text(ch, ["line"]).first().text == "永寺 樂"
    one = spark.range(1)
    assert one.select(D.missing_spacing(F.array(*[F.lit(x) for x in ("永", "MISS", "MISS")])).alias("x")).first().x == "永MISS MISS"
    assert one.select(D.annotations_text(F.create_map(*[F.lit(x) for x in ("10", "庚", "2", "乙", "1", "甲")])).alias("x")).first().x == "甲乙庚"
    assert one.select(D.token_of_box(F.array(F.lit(3), F.lit(1)), F.array(F.lit("a"), F.lit("b")), F.lit(1)).alias("x")).first().x == "b"
    st = spark.createDataFrame([(1, "1 0 0 1 5.5 7. Tm /F1 10 Tf <0041 0042> Tj 1 0 0 -1 6 .9 Tm\n/F1 9 Tf [<0041>-20<00420043> 3] TJ 1 0 0 1 5.5 7 Tm /F1 8 Tf <00410042>Tj 1 0 0 1 1 1 Tm /F1 9 Tf <004> Tj 1 0 0 1 1 1 Tm /F9 9 Tf <0041> Tj", 100.0)], "page int, content string, h double")
    fonts = spark.createDataFrame([(1, "F1", "n", 11)], "page int, resource string, name string, font int")
    assert sorted((r.run, r.name, r.font, r.x, r.y, r.codes) for r in D.font_runs(st, fonts).collect()) == [(0, "n", 11, 5.5, 7.0, [65, 66]), (1, "n", 11, 6.0, 0.9, [65, 66, 67])]
    assert sorted(r.y for r in D.font_runs(st, fonts, "h").collect()) == [93.0, 99.1]
    bases = spark.createDataFrame([(1, "ABCDEF+Palatino"), (1, "Ariel")], "page int, base string")
    fonts = spark.createDataFrame([(1, "Palatino-Bold"), (1, "Times")], "page int, font string")
    assert {r.base: r.font for r in D.font_of_page(bases, fonts).collect()} == {"ABCDEF+Palatino": "Palatino-Bold", "Ariel": None}


def plain_fonts(text, places, runs):
    """The rule of ``assign_fonts`` for one span, place by place; runs: (x, y, codes, font) in order."""

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    have = [None] * len(text)
    for i, (x, y) in enumerate(places):
        found = [(shared(text[i:], c), f) for rx, ry, c, f in runs if (round(rx, 2), round(ry, 2), c[0]) == (round(x, 2), round(y, 2), text[i])]
        if found:
            n, f = max(found, key=lambda m: m[0])
            have[i : i + n] = [f] * n
    for i, (_, y) in enumerate(places):
        if have[i] is None:
            found = [(shared(text[i:], c[o:]), f) for _, ry, c, f in runs if abs(ry - y) <= 0.02 for o in range(len(c))]
            n = max((m[0] for m in found), default=0)
            if n and len({f for m, f in found if m == n}) == 1:
                have[i : i + n] = [f for m, f in found if m == n][:1] * n
    return have


def test_runs_at_any_offset_by_plain_python(spark):
    rnd, chars, runs, want = random.Random(8), [], [], {}
    for page in range(30):
        lines = [rnd.choice((50.0, 50.01, 50.1, 80.0)) for _ in range(rnd.randint(1, 6))]
        here = [(10.0 * rnd.randint(0, 4), y, [rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))], rnd.choice(("f", "g", "h"))) for y in lines]
        runs += [(page, i, "n", f, x, y, c) for i, (x, y, c, f) in enumerate(here)]
        for span in range(4):
            y, x = rnd.choice((50.0, 50.02, 80.0, 81.0)), 10.0 * rnd.randint(0, 3)
            text = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))]
            if rnd.random() < 0.7:  # pieces of runs
                text = (rnd.choice(here)[2] + rnd.choice(here)[2])[rnd.randint(0, 2) :] or text
            places = [(x + 10.0 * i, y) for i in range(len(text))]
            chars += [(page, span, i, "n", px, py, c) for i, ((px, py), c) in enumerate(zip(places, text, strict=True))]
            want |= {(page, span, i): f for i, f in enumerate(plain_fonts(text, places, here))}
    fonts = [(p, "n", f) for p in range(30) for f in ("f", "g")] + [(99, "n", "only")]
    chars += [(99, 0, 0, "n", 0.0, 0.0, 7), (98, 0, 0, "n", 0.0, 0.0, 7)]
    want |= {(99, 0, 0): "only", (98, 0, 0): None}
    out = D.assign_fonts(
        spark.createDataFrame(chars, "page int, span int, pos int, name string, x double, y double, code int"),
        spark.createDataFrame(runs, "page int, run int, name string, font string, x double, y double, codes array<int>"),
        spark.createDataFrame(fonts, "page int, name string, font string"),
    )
    got = {(r.page, r.span, r.pos): r.font for r in out.collect()}
    assert got == want and len({*want.values()}) == 5


def rejected(state, action, payload, why):
    with pytest.raises(W.Rejected, match=why):
        W.apply(state, action, payload)


def test_fields():
    s = W.start(10, 10, {"Text": "永", "Note": "a"}, {"Text": "永寺", "Note": "b"})
    s = W.apply(s, "field", {"path": "Note", "value": "c"})
    assert s["draft"] == {"Text": "永寺", "Note": "c"}
    rejected(s, "field", {"path": "No", "value": ""}, "path")
    rejected(s, "field", {"path": "Note", "value": 1}, "value")
    assert W.apply(s, "undo", {})["draft"] == {"Text": "永寺", "Note": "b"} and W.apply(s, "original", {})["draft"] == {"Text": "永", "Note": "a"}
    rejected(W.apply(s, "field", {"path": "Text", "value": "  "}), "save_content", {"title": "Text"}, "text")
    s = W.apply(s, "save_content", {"title": "Text"})
    assert s["text"] == "永寺" and s["step"] == W.BOXES
    rejected(s, "field", {"path": "Note", "value": ""}, "step")
    rejected(W.apply(s, "undo", {}), "add", {"bbox": [0, 0, 1, 1]}, "content")


def test_selection_and_commit():
    s = go(THREE, ("select", {"id": 1}), ("select", {"id": 3, "toggle": True}))
    assert s["selected"] == ["1", "3"] and s["active"] == "3"
    assert W.apply(s, "select", {"id": 3, "toggle": True})["active"] == "1"
    rejected(s, "select", {"id": 9}, "id")
    boxes = {"3": [0, 20, 9, 30], "1": {"bbox": [0, 0, 9, 9]}, "new": [50, 50, 60, 60]}
    t = W.apply(s, "commit_boxes", {"boxes": boxes, "active": "new", "selected": ["3", "new", "gone"], "orders": {"1": 3, "3": 1, "new": 2}, "statuses": {"3": "damaged"}, "damage_levels": {"3": 2}, "suspiciouses": {"new": True}})
    assert [t["boxes"][i]["bbox"] for i in "123"] == [[0, 0, 9, 9], [0, 20, 9, 30], [50, 50, 60, 60]]
    assert t["order"] == ["2", "3", "1"] and t["selected"] == ["2", "3"] and t["active"] == "3"
    assert t["boxes"]["2"]["level"] == 2 and t["boxes"]["3"]["suspicious"]
    assert W.apply(s, "commit_boxes", {"boxes": boxes, "orders": {"1": 1, "3": 1, "new": 2}})["order"] == []
    rejected(s, "commit_boxes", {"boxes": {"1": [0, 0, 900, 9]}}, "bbox")
    assert W.apply(s, "commit_boxes", {"boxes": boxes, "selection_cleared": True, "selected": ["1"]})["selected"] == []


def test_flags_of_one_box():
    s = go(THREE, ("sort_boxes", {"order": [1, 2, 3]}), ("next", {}), text="永□@")
    assert s["boxes"]["2"]["unknown"] and s["boxes"]["2"]["damaged"] and s["boxes"]["3"]["unavailable_font"]
    t = W.apply(s, "suspicious", {"id": 1, "value": True})
    assert t["boxes"]["1"]["suspicious"]
    rejected(s, "suspicious", {"id": 7, "value": True}, "id")
    t = W.apply(t, "status", {"id": 1, "status": "damaged", "unknown": True})["boxes"]["1"]
    assert t["unknown"] and not t["suspicious"]
    t = W.apply(s, "status", {"id": 1, "status": "intact", "expert_prediction": True, "damage_level": 3})["boxes"]["1"]
    assert t["damaged"] and t["level"] == 3
    rejected(s, "status", {"id": 1, "status": "damaged", "damage_level": 4}, "level")
    rejected(s, "status", {"id": 1, "status": "damaged", "suspicious": 1}, "flags")


def test_alignment_is_preserved():
    s = go(THREE, ("sort_boxes", {"order": [2, 3, 1]}), ("next", {}), ("reorder_text", {"tokens": list("樂永寺")}), ("back", {}), ("sort_boxes", {"order": [2, 3, 1]}), ("save_content", {"text": "永寺樂"}), ("next", {}))
    assert s["tokens"] == list("樂永寺")
    s = W.apply(W.apply(W.apply(s, "back", {}), "sort_boxes", {"order": [1, 2, 3]}), "next", {})
    assert s["tokens"] == list("永寺樂")


def test_saved_crop():
    s = go(THREE, ("sort_boxes", {"order": [1, 2, 3]}), ("next", {}), ("statuses", {"ids": [1], "damaged": True, "level": 1}), ("next", {}), ("crop", {"bbox": [0, 0, 50, 50]}), ("save_crop", {}))
    assert s["crop_saved"] and not W.apply(s, "crop", {"bbox": [0, 0, 9, 9]})["crop_saved"]
    rejected(go(THREE), "save_crop", {}, "step")
