"""Constraints as queries that return violations, and the columns that gates are derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, from_corners, valid
from ..functions.text import MISSING, NO_FONT, UNKNOWN, graphemes

FLAGS = ("unknown", "unavailable_font", "expert_prediction", "suspicious")
OTHERS = FLAGS[1:]
KINDS = ("missing_text", "extra_text", "other")


def damaged(status: Column) -> Column:
    return status == "damaged"


def level_ok(status: Column, level: Column) -> Column:
    """Null, or 1 to 3 on a damaged box."""
    return level.isNull() | (level.between(1, 3) & damaged(status))


def flags_ok(status: Column) -> Column:
    """Flags are set or unset; unknown needs a damaged box and no other flag."""
    none = F.lit(True)
    for f in FLAGS:
        none = none & F.col(f).isNotNull()
    alone = damaged(status) & ~F.coalesce(F.col("unavailable_font"), F.lit(False)) & ~F.coalesce(F.col("expert_prediction"), F.lit(False)) & ~F.coalesce(F.col("suspicious"), F.lit(False))
    return none & (~F.col("unknown") | alone)


def normalized_flags(df: DataFrame, token: str | None = None) -> DataFrame:
    """Intact boxes lose level and unknown; missing characters lose all flags."""
    hurt = damaged(F.col("status"))
    miss = (F.col(token) == MISSING) if token else F.lit(False)
    out = {"damage_level": F.when(hurt, F.col("damage_level")), "unknown": F.col("unknown") & hurt & ~miss}
    out |= {f: F.col(f) & ~miss for f in OTHERS}
    return df.withColumns(out)


def placeholder_ok(token: Column) -> Column:
    """An unknown sign stands on a damaged unknown box, a missing-font sign on a box flagged so."""
    return F.when(token == UNKNOWN, damaged(F.col("status")) & F.col("unknown")).when(token == NO_FONT, F.col("unavailable_font")).otherwise(F.lit(True))


def updated_flags(df: DataFrame) -> DataFrame:
    """old_* and new_* flags -> flags: unknown newly set clears the others, another newly set clears
    unknown, expert newly set makes the box damaged."""
    fresh = {f: F.col(f"new_{f}") & ~F.col(f"old_{f}") for f in FLAGS}
    other = fresh["unavailable_font"] | fresh["expert_prediction"] | fresh["suspicious"]
    out = {"unknown": F.col("new_unknown") & (fresh["unknown"] | ~other)}
    for f in OTHERS:
        out[f] = F.col(f"new_{f}") & ~fresh["unknown"]
    out["status"] = F.when(fresh["expert_prediction"] & ~fresh["unknown"], "damaged").otherwise(F.col("new_status"))
    return df.withColumns(out)


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def box_violations(boxes: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("status")
    return violations(boxes, keys, {"status": s.isin("damaged", "intact"), "damage_level": level_ok(s, F.col("damage_level")), "flags": flags_ok(s), "bbox": valid(Box.of(), F.col("width"), F.col("height"))})


def level_missing(boxes: DataFrame, group: str) -> DataFrame:
    """Groups with damaged boxes that have no level."""
    return boxes.where(damaged(F.col("status")) & F.col("damage_level").isNull()).groupBy(group).agg(F.count("*").alias("n_missing"))


def document_violations(docs: DataFrame, key: str = "image") -> DataFrame:
    """docs(image, width, height, bounding_boxes map, annotations map, crop struct): ids 1..n, equal key sets,
    boxes inside, levels and flags, annotations of one character or MISS, rectangular crop."""
    ids = F.transform(F.map_keys("bounding_boxes"), lambda k: k.try_cast("int"))
    n = F.size("bounding_boxes")
    boxes = F.map_values("bounding_boxes")
    at = lambda b, i: F.get(b["bbox"], F.lit(i))
    inside = F.forall(boxes, lambda b: (F.size(b["bbox"]) == 4) & valid(Box(at(b, 0), at(b, 1), at(b, 2), at(b, 3)), F.col("width"), F.col("height")))
    levels = F.forall(boxes, lambda b: F.coalesce(level_ok(b["status"], b["damage_level"]), F.lit(False)))
    unknown = F.forall(boxes, lambda b: ~b["unknown"] | (damaged(b["status"]) & ~b["unavailable_font"] & ~b["expert_prediction"] & ~b["suspicious"]))
    signs = F.forall(F.map_values("annotations"), lambda a: (a == MISSING) | (F.size(graphemes(a)) == 1))
    rect, _ = from_corners(F.col("crop"))
    return violations(docs, [key], {
        "box_ids": (F.array_sort(ids) == F.sequence(F.lit(1), n)) & (n > 0),
        "annotation_keys": F.array_sort(F.map_keys("annotations")) == F.array_sort(F.map_keys("bounding_boxes")),
        "bbox": inside, "damage_level": levels, "flags": unknown, "annotation": signs, "crop": rect,
    })


def mismatch_violations(df: DataFrame, key: str = "image") -> DataFrame:
    """df(image, issue_type, note, n_boxes, characters array, sequence array, excluded array)."""
    kind, n, m = F.col("issue_type"), F.col("n_boxes"), F.size("characters")
    miss = F.size(F.filter("sequence", lambda x: x == MISSING))
    real = F.filter("sequence", lambda x: x != MISSING)
    kept = F.slice("sequence", 1, F.greatest(n, F.lit(0)))
    tail = F.when(F.size("sequence") > n, F.slice("sequence", n + 1, F.greatest(F.size("sequence") - n, F.lit(0)))).otherwise(F.expr("cast(array() as array<string>)"))
    same = F.array_sort(real) == F.array_sort("characters")
    return violations(df, [key], {
        "kind": kind.isin(*KINDS),
        "direction": F.when(kind == "missing_text", n > m).when(kind == "extra_text", n < m).otherwise(F.lit(True)),
        "padding": F.when(kind == "missing_text", miss == n - m).when(kind == "extra_text", miss == 0).otherwise(F.lit(True)),
        "characters": F.when(kind == "other", F.lit(True)).otherwise(same),
        "excluded": F.when(kind == "extra_text", (tail == F.col("excluded")) & (F.size(kept) == n)).otherwise(F.coalesce(F.size("excluded"), F.lit(0)) <= 0),
        "note": F.when(kind == "other", F.coalesce(F.trim("note"), F.lit("")) != "").otherwise(F.lit(True)),
    })


def count_gate(df: DataFrame, characters: str, boxes: str) -> DataFrame:
    """bbox_valid, and the signed difference boxes - characters."""
    return df.withColumns({"bbox_valid": (F.col(boxes) == F.col(characters)) & (F.col(boxes) > 0), "difference": F.col(boxes) - F.col(characters)})


def permutation_ok(order: Column, ids: Column) -> Column:
    return F.array_sort(order) == F.array_sort(ids)


def gates(df: DataFrame) -> DataFrame:
    """Steps of an annotation as columns of its present state: nothing is stored, so nothing is stale.
    df: text_ok, n_chars, n_boxes, order_ok, levels_ok, sequence_ok, crop_ok, mismatch (kind or null), mismatch_text_same."""
    counts = (F.col("n_chars") == F.col("n_boxes")) & (F.col("n_boxes") > 0)
    excused = F.coalesce(F.col("mismatch").isNotNull() & F.col("mismatch_text_same"), F.lit(False))
    content = F.col("text_ok")
    boxes = content & (counts | excused)
    order = boxes & F.col("order_ok")
    status = order & F.col("levels_ok") & (F.col("sequence_ok") | (F.col("mismatch") == "other"))
    return df.withColumns({"gate_content": content, "gate_boxes": boxes, "gate_order": order, "gate_status": F.coalesce(status, F.lit(False)), "gate_save": F.coalesce(status & F.col("crop_ok"), F.lit(False))})


def qa_report(faces: DataFrame, image_keys: DataFrame | None, file: str = "file", key: str = "face_key") -> DataFrame:
    """(file, faces, errors, verdict): null keys, keys in more than one place, keys without exactly one image."""
    null = faces.where(F.col(key).isNull()).groupBy(file).agg(F.count("*").alias("n"))
    twice = faces.where(F.col(key).isNotNull()).groupBy(file, key).agg(F.count("*").alias("c")).where("c > 1").groupBy(file).agg(F.count("*").alias("n"))
    parts = null.unionByName(twice)
    if image_keys is not None:
        counts = image_keys.groupBy(key).agg(F.count("*").alias("c"))
        off = faces.where(F.col(key).isNotNull()).select(file, key).distinct().join(counts, key, "left").where(F.coalesce("c", F.lit(0)) != 1).groupBy(file).agg(F.count("*").alias("n"))
        parts = parts.unionByName(off)
    errors = parts.groupBy(file).agg(F.sum("n").alias("errors"))
    total = faces.groupBy(file).agg(F.count("*").alias("faces"))
    return total.join(errors, file, "left").select(file, "faces", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.when(F.coalesce("errors", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("verdict"))
