"""Saved documents and payloads: what is wrong with them, and what of them can be restored."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, fingerprint, graphemes
from .validate import violations


def suspicious_boxes(docs: DataFrame, key: str = "image") -> DataFrame:
    """(image, id) of the boxes flagged as suspicious, whatever their annotation."""
    return docs.select(key, F.explode("bounding_boxes").alias("id", "b")).where("b.suspicious").select(key, "id")


def content_violations(docs: DataFrame, titles: list[str] | None = None, key: str = "image") -> DataFrame:
    """docs(image, inscription_code, content map, asked): the document belongs to the picture asked for, its code is
    the picture's stem, and its sections are named, and exactly ``titles`` if given. Null texts are allowed."""
    name = F.element_at(F.split("asked", "/"), -1)
    heads = F.map_keys("content")
    rules = {
        "image": F.col(key) == name,
        "inscription_code": F.col("inscription_code") == F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""),
        "content": F.col("content").isNotNull(),
        "headings": F.col("content").isNull() | F.forall(heads, lambda h: h != ""),
    }
    if titles is not None:
        rules["sections"] = F.col("content").isNull() | (F.array_sort(heads) == F.array_sort(F.array(*[F.lit(t) for t in titles])))
    return violations(docs, [key], rules)


def hydrated(saved: DataFrame, sources: DataFrame, key: str = "image") -> DataFrame:
    """What a saved alignment gives back when its picture is opened again.

    saved(image, fingerprint, issue_type or null, boxes array of ids, annotations map id -> sign, text_sequence array);
    sources(image, text). restored: the text is still the one that was aligned. aligned: restored, annotations and
    boxes have the same ids, and the signs are the text's (those of text_sequence if text is in excess; without
    missing signs if boxes are). sequence: signs in the order of numeric ids, or text_sequence; null if not aligned.
    """
    s = sources.select(key, fingerprint(F.col("text")).alias("__h"), graphemes(F.col("text")).alias("__c"))
    kind = F.coalesce("issue_type", F.lit("none"))
    ids = F.array_sort(F.transform(F.map_keys("annotations"), lambda i: i.cast("int")))
    signs = F.transform(ids, lambda i: F.try_element_at("annotations", i.cast("string")))
    text = F.when(kind == "extra_text", F.col("text_sequence")).when(kind == "missing_text", F.filter(signs, lambda c: c != MISSING)).otherwise(signs)
    restored = F.coalesce(F.col("fingerprint") == F.col("__h"), F.lit(False))
    same = (F.size(ids) > 0) & (F.array_sort(F.map_keys("annotations")) == F.array_sort("boxes")) & (F.array_sort(text) == F.array_sort("__c"))
    out = saved.join(s, key, "left").withColumn("restored", restored)
    out = out.withColumn("aligned", F.col("restored") & F.coalesce(same, F.lit(False)) & (kind != "other"))
    return out.withColumn("sequence", F.when(F.col("aligned"), F.when(kind == "extra_text", F.col("text_sequence")).otherwise(signs))).drop("__h", "__c")


# ---------------------------------------------------------------- payloads


def _all(values, test) -> bool:
    return all(test(v) for v in values)


def _text(v) -> bool:
    return isinstance(v, str)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _named(d: dict, name: str, test) -> bool:
    """A missing member counts as empty."""
    v = d.get(name, {})
    return isinstance(v, dict) and _all(v.values(), test)


def _four(v) -> bool:
    box = v.get("bbox") if isinstance(v, dict) else v
    return isinstance(box, list) and len(box) == 4


def _list_of_text(d: dict, name: str) -> bool:
    v = d.get(name)
    return v is None or (isinstance(v, list) and _all(v, lambda x: _text(x) and x != ""))


#: Kind of payload -> member -> its test. Members that aren't named here are ignored.
PAYLOADS: dict[str, dict[str, Callable[[dict], bool]]] = {
    "boxes": {"boxes": lambda d: _named(d, "boxes", _four), "selected": lambda d: isinstance(d.get("selected", []), list)},
    "crop": {"crop": lambda d: d.get("crop") is None or (_four(d["crop"]) and isinstance(d["crop"], list) and _all(d["crop"], _number))},
    "sequence": {"textSequence": lambda d: _list_of_text(d, "textSequence"), "tokenOrder": lambda d: _list_of_text(d, "tokenOrder")},
    "status": {
        "statuses": lambda d: _named(d, "statuses", lambda v: v in ("intact", "damaged")),
        **{f: (lambda d, f=f: _named(d, f, lambda v: isinstance(v, bool))) for f in ("unknowns", "unavailable_fonts", "expert_predictions", "suspiciouses")},
        "damage_levels": lambda d: _named(d, "damage_levels", lambda v: v is None or (type(v) is int and 1 <= v <= 3)),
    },
}


def payload_problem(kind: str, text: str | None) -> str | None:
    """The first member of a payload that breaks the schema of its kind; ``json`` if it is no object; null if all is
    well. A null or empty payload is an empty object."""
    if kind not in PAYLOADS:
        return "kind"
    try:
        d = json.loads(text or "{}")
    except ValueError:
        return "json"
    if not isinstance(d, dict):
        return "json"
    return next((m for m, ok in PAYLOADS[kind].items() if not ok(d)), None)


def payload_problems(kind: Column, payload: Column) -> Column:
    """payload_problem of two columns; JSON whose members differ in type from row to row is read in Python, in batches."""

    @F.pandas_udf("string")
    def check(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([payload_problem(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)

    return check(kind, payload)
