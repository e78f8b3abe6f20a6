"""Annotation sessions as logs of actions: state is a fold over ordered actions, one session at a time.

The last accepted state of each session is a row. An action that is out of step, stale or invalid is
rejected with its reason and changes nothing, so a log can be replayed at any time.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING, NO_FONT, UNKNOWN
from .validate import FLAGS

#: The steps of a session.
IMAGE, CONTENT, BOXES, STATUS, CROP, REVIEW = 1, 2, 3, 4, 6, 7


class Rejected(ValueError):
    pass


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Rejected(why)


def start(width: int, height: int, source: dict[str, str] | None = None, saved: dict[str, str] | None = None) -> dict:
    """A new session. source: the picture's fields by label; saved: those of an earlier session, which undo goes back to."""
    source = source or {}
    base = source if saved is None else saved
    return {
        "step": CONTENT, "revision": 0, "width": width, "height": height, "text": "", "boxes": {}, "order": [], "tokens": [], "mismatch": None, "crop": None, "saved": False,
        "source": source, "baseline": base, "draft": dict(base), "verified": False, "aligned": [], "selected": [], "active": None, "crop_saved": False,
    }


def _box(s: dict, p: dict) -> list[float]:
    b = [float(x) for x in p["bbox"]]
    _need(len(b) == 4 and all(abs(x) < float("inf") for x in b) and 0 <= b[0] < b[2] <= s["width"] and 0 <= b[1] < b[3] <= s["height"], "bbox")
    return b


def _plain(bbox: list[float], damaged: bool = False) -> dict:
    return {"bbox": bbox, "damaged": damaged, "level": None} | dict.fromkeys(FLAGS, False)


def _content(s, p):
    text = p["text"] if "text" in p else s["draft"].get(p["title"])
    _need(isinstance(text, str) and bool(text.strip()), "text")
    if text != s["text"]:
        s |= {"tokens": [], "mismatch": None}
    s |= {"text": text, "verified": True, "step": max(s["step"], BOXES)}


def _field(s, p):
    _need(s["step"] == CONTENT, "step")
    _need(p["path"] in s["draft"], "path")
    _need(isinstance(p["value"], str), "value")
    s["draft"][p["path"]] = p["value"]
    s["verified"] = False


def _revert(to: str):
    def back(s, _p):
        s |= {"draft": dict(s[to]), "verified": False}

    return back


def _edits_boxes(s):
    _need(s["step"] >= BOXES, "step")
    _need(s["verified"], "content")


def _changed_boxes(s, boxes: dict):
    """Another set of boxes: what was derived from the old one goes."""
    s |= {"boxes": boxes, "order": [], "tokens": [], "aligned": [], "mismatch": None, "selected": [i for i in s["selected"] if i in boxes]}
    if s["active"] not in boxes:
        s["active"] = s["selected"][-1] if s["selected"] else None


def _detect(s, p):
    _edits_boxes(s)
    s |= {"selected": [], "active": None}
    _changed_boxes(s, {str(i): _plain(_box(s, {"bbox": b}), i <= p.get("damaged", 0)) for i, b in enumerate(p["boxes"], 1)})


def _add(s, p):
    _edits_boxes(s)
    new = str(max(map(int, s["boxes"]), default=0) + 1)
    _changed_boxes(s, s["boxes"] | {new: _plain(_box(s, p))})
    s |= {"selected": [new], "active": new}


def _commit(s, p):
    """The client's boxes as a whole: id -> corners, or an object with ``bbox``. Ids it doesn't name are deleted, ids that
    aren't known are new boxes; boxes are numbered anew, old ones first."""
    _edits_boxes(s)
    got = {str(i): _box(s, b if isinstance(b, dict) else {"bbox": b}) for i, b in p["boxes"].items()}
    kept = sorted((i for i in got if i in s["boxes"]), key=int)
    names = kept + [i for i in got if i not in s["boxes"]]
    new = {old: str(n) for n, old in enumerate(names, 1)}
    boxes = {new[i]: s["boxes"].get(i, _plain([])) | {"bbox": got[i]} for i in names}
    for i, status in p.get("statuses", {}).items():
        _need(status in ("damaged", "intact"), "status")
        if i in new:
            boxes[new[i]]["damaged"] = status == "damaged"
    for flag, member in zip(FLAGS, ("unknowns", "unavailable_fonts", "expert_predictions", "suspiciouses"), strict=True):
        for i, v in p.get(member, {}).items():
            if i in new:
                boxes[new[i]][flag] = v
    for i, level in p.get("damage_levels", {}).items():
        if i in new:
            boxes[new[i]]["level"] = level
    boxes = {i: _settled(b) for i, b in boxes.items()}
    if names != sorted(s["boxes"], key=int):
        _changed_boxes(s, boxes)
    s["boxes"] = boxes
    orders = {new[str(i)]: n for i, n in p.get("orders", {}).items() if str(i) in new}
    if orders:
        # an order that isn't complete is a draft: it is no reading order yet
        s["order"] = sorted(orders, key=orders.get) if sorted(v for v in orders.values() if type(v) is int) == list(range(1, len(boxes) + 1)) else []
    s["selected"] = [] if p.get("selection_cleared") else [new[str(i)] for i in p.get("selected", []) if str(i) in new]
    s["active"] = None if p.get("selection_cleared") else new.get(str(p.get("active")))


def _select(s, p):
    i = str(p["id"])
    _need(i in s["boxes"], "id")
    if s["step"] != BOXES or not p.get("toggle"):
        s |= {"selected": [i], "active": i}
    elif i in s["selected"]:
        s["selected"].remove(i)
        if s["active"] == i:
            s["active"] = s["selected"][-1] if s["selected"] else None
    else:
        s["selected"].append(i)
        s["active"] = i


def _token(s, i: str) -> str | None:
    at = s["order"].index(i) if i in s["order"] else len(s["tokens"])
    return s["tokens"][at] if at < len(s["tokens"]) else None


def _settled(box: dict, token: str | None = None) -> dict:
    """A box whose flags agree with its status and its sign; Rejected if they can't."""
    b = dict(box)
    _need(all(isinstance(b[f], bool) for f in FLAGS), "flags")
    _need(b["level"] is None or (type(b["level"]) is int and 1 <= b["level"] <= 3), "level")
    if token == UNKNOWN:
        b |= dict.fromkeys(FLAGS, False) | {"damaged": True, "unknown": True}
    elif token == NO_FONT:
        b |= {"unknown": False, "unavailable_font": True}
    elif token == MISSING:
        b |= dict.fromkeys(FLAGS, False)
    if not b["damaged"]:
        b |= {"level": None, "unknown": False}
    _need(not b["unknown"] or not any(b[f] for f in FLAGS[1:]), "flags")
    return b


def _flag_status(s, p):
    """Status, level and flags of one box: a newly set flag displaces those that it can't stand with."""
    _need(s["step"] == STATUS, "step")
    i = str(p.get("id") or s["active"])
    _need(i in s["boxes"], "id")
    old = s["boxes"][i]
    _need(p["status"] in ("damaged", "intact"), "status")
    new = old | {f: p[f] for f in FLAGS if p.get(f) is not None} | {"damaged": p["status"] == "damaged"}
    fresh = {f for f in FLAGS if new[f] is True and not old[f]}
    if "unknown" in fresh:
        new |= dict.fromkeys(FLAGS[1:], False)
    elif fresh:
        new["unknown"] = False
    if "expert_prediction" in fresh and new["expert_prediction"]:
        new["damaged"] = True
    if "damage_level" in p:
        new["level"] = p["damage_level"]
    elif not old["damaged"]:
        new["level"] = None
    s["boxes"][i] = _settled(new, _token(s, i))


def _suspicious(s, p):
    _need(s["step"] == STATUS, "step")
    i = str(p.get("id") or "")
    _need(i in s["boxes"] and _token(s, i) != MISSING, "id")
    _flag_status(s, {"id": i, "status": "damaged" if s["boxes"][i]["damaged"] else "intact", "suspicious": p["value"]})


def _update(s, p):
    _need(str(p["id"]) in s["boxes"], "id")
    s["boxes"][str(p["id"])]["bbox"] = _box(s, p)


def _delete(s, p):
    ids = list(dict.fromkeys(map(str, p["ids"])))
    _need(all(i in s["boxes"] for i in ids), "id")
    left = [b for i, b in sorted(s["boxes"].items(), key=lambda x: int(x[0])) if i not in ids]
    s |= {"selected": [], "active": None}
    _changed_boxes(s, {str(i): b for i, b in enumerate(left, 1)})


def _sort(s, p):
    _need(sorted(map(str, p["order"])) == sorted(s["boxes"]), "order")
    s["order"] = [str(x) for x in p["order"]]


def _mismatch(s, p):
    n, m = len(s["boxes"]), len(s["text"])
    kind = p["kind"]
    _need(kind in ("missing_text", "extra_text", "other"), "kind")
    _need({"missing_text": n > m, "extra_text": n < m, "other": True}[kind], "direction")
    _need(kind != "other" or bool(p.get("note", "").strip()), "note")
    s["mismatch"] = kind


def _status(s, p):
    for i in p["ids"]:
        _need(str(i) in s["boxes"], "id")
    level = p.get("level")
    _need(level is None or (type(level) is int and 1 <= level <= 3 and p["damaged"]), "level")
    for i in p["ids"]:
        s["boxes"][str(i)] |= {"damaged": bool(p["damaged"]), "level": level if p["damaged"] else None}


def _reorder(s, p):
    _need(sorted(p["tokens"]) == sorted(s["tokens"]), "tokens")
    s["tokens"] = list(p["tokens"])


def _next(s, _p):
    n, m = len(s["boxes"]), len(s["text"])
    if s["step"] == BOXES:
        _need(s["verified"], "content")
        _need(n > 0, "boxes")
        _need(n == m or s["mismatch"] is not None, "counts")
        _need(s["mismatch"] == "other" or sorted(s["order"]) == sorted(s["boxes"]), "order")
        # signs that were moved by hand stay while boxes, their order and the text do
        if not (s["tokens"] and s["aligned"] == s["order"] and len(s["tokens"]) == max(n, m) and Counter(t for t in s["tokens"] if t != MISSING) == Counter(s["text"])):
            s["tokens"] = list(s["text"]) + [MISSING] * max(0, n - m)
        s["aligned"] = list(s["order"])
        s["boxes"] = {i: _settled(b, _token(s, i)) for i, b in s["boxes"].items()}
        s["step"] = REVIEW if s["mismatch"] == "other" else STATUS
    elif s["step"] == STATUS:
        _need(all(b["level"] is not None for b in s["boxes"].values() if b["damaged"]), "level")
        s["step"] = CROP
    elif s["step"] == CROP:
        _need(s["crop"] is not None, "crop")
        s["step"] = REVIEW
    else:
        raise Rejected("step")


def _crop(s, p):
    s |= {"crop": _box(s, p), "crop_saved": False}


def _save_crop(s, _p):
    _need(s["step"] == CROP, "step")
    s["crop_saved"] = True


def _back(s, _p):
    steps = [CONTENT, BOXES, STATUS, CROP, REVIEW]
    _need(s["step"] in steps[1:], "step")
    s["step"] = BOXES if s["step"] == REVIEW and s["mismatch"] == "other" else steps[steps.index(s["step"]) - 1]


def _save(s, _p):
    _need(s["step"] == REVIEW, "step")
    s |= {"saved": True, "crop_saved": True}


ACTIONS: dict[str, Callable[[dict, dict], None]] = {
    "save_content": _content, "detect": _detect, "add": _add, "update": _update, "delete": _delete, "sort_boxes": _sort, "confirm_source_mismatch": _mismatch,
    "clear_source_mismatch": lambda s, p: s.update(mismatch=None), "statuses": _status, "reorder_text": _reorder, "next": _next, "crop": _crop, "back": _back, "save": _save,
    "field": _field, "undo": _revert("baseline"), "original": _revert("source"), "select": _select, "suspicious": _suspicious, "status": _flag_status, "commit_boxes": _commit, "save_crop": _save_crop,
}


def apply(state: dict, action: str, payload: dict, revision: int | None = None) -> dict:
    """The next state; raises Rejected, and leaves the old state as it was, if the action is not allowed."""
    _need(revision is None or revision == state["revision"], "revision")
    _need(action in ACTIONS, "action")
    new = json.loads(json.dumps(state))
    ACTIONS[action](new, payload)
    if action != "save":
        new["saved"] = False
    new["revision"] += 1
    return new


def replay(log: DataFrame) -> DataFrame:
    """log(session, seq, action, payload JSON, revision, width, height, optionally source and saved: JSON objects of
    fields) -> (session, seq, accepted, reason, state JSON) of every action. A session is short; sessions are
    spread over the cluster."""
    given = [c for c in ("source", "saved") if c in log.columns]
    schema = "session string, seq long, accepted boolean, reason string, state string"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        state, out = start(int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0]), **{c: json.loads(pdf[c].iloc[0]) for c in given if pdf[c].iloc[0]}), []
        for r in pdf.itertuples():
            why = None
            try:
                state = apply(state, r.action, json.loads(r.payload or "{}"), None if pd.isna(r.revision) else int(r.revision))
            except (Rejected, KeyError, TypeError, ValueError, AttributeError) as e:
                why = str(e) or type(e).__name__
            out.append((key[0], r.seq, why is None, why, json.dumps(state, sort_keys=True, ensure_ascii=False)))
        return pd.DataFrame(out, columns=["session", "seq", "accepted", "reason", "state"])

    return log.groupBy("session").applyInPandas(run, schema)


def final_states(replayed: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    return replayed.withColumn("__r", last).where("__r = 1").select("session", "state")


def fresh(revisions: DataFrame, stored: DataFrame, key: str = "image") -> DataFrame:
    """revisions(key, revision) with accepted where the stored revision is still that one."""
    s = stored.select(key, F.col("revision").alias("__r"))
    return revisions.join(s, key, "left").withColumn("accepted", F.coalesce(F.col("revision") == F.col("__r"), F.lit(False))).drop("__r")


def restored(saved: DataFrame, sources: DataFrame, key: str = "image") -> DataFrame:
    """Saved documents with restored: whether the fingerprint of the text they were aligned to is still that
    of the source."""
    s = sources.select(key, F.sha2(F.col("text").cast("binary"), 256).alias("__h"))
    return saved.join(s, key, "left").withColumn("restored", F.coalesce(F.col("fingerprint") == F.col("__h"), F.lit(False))).drop("__h")
