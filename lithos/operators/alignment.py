"""Alignment of signs and boxes of many documents at once: what a new order keeps, rearranged signs, and statuses replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, NO_FONT, UNKNOWN
from .relational import match_once, same_multiset
from .validate import FLAGS, OTHERS, damaged, updated_flags


def realigned(docs: DataFrame, order: DataFrame, old: DataFrame, group: str = "image") -> DataFrame:
    """(group, pos, uid, token, token_id): the signs of each document at the places of its boxes, and behind them those that are left out.

    docs(group, chars, kind, excluded, extra_ids): signs of the text; a confirmed mismatch (missing_text, extra_text, other) or null; signs that were left out, and the
    ids of their tokens. order(group, uid, pos): boxes by place, from 1. old(group, uid, pos, token, token_id): the alignment before.

    Boxes keep their signs where the boxes and their order are the same, each had a sign, and these signs without the missing ones, with those left out of
    a text in excess, are the text's as often as they are there. Otherwise signs are dealt out in order: where there are as many as boxes; with missing ones at the
    end of a text that lacks some; and of a text in excess the first. Any other document gets none. Tokens keep their ids only with their signs, and if all have one."""
    was = old.select(group, "uid", F.col("pos").alias("__pos"), F.col("token").alias("__token"), F.col("token_id").alias("__id"))
    both = order.select(group, "uid", "pos").join(was, [group, "uid"], "left")
    held = F.collect_list(F.when(F.col("__token") != MISSING, F.col("__token")))
    state = both.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("pos") == F.col("__pos")).alias("same"), F.count("__token").alias("signed"), F.count("__id").alias("named"), held.alias("held"))
    before = old.groupBy(group).agg(F.count("*").alias("before"))
    d = docs.select(group, "chars", "kind", "excluded", "extra_ids").join(state, group, "left").join(before, group, "left")
    none = F.expr("cast(array() as array<string>)")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "same", "signed", "named", "before")} | {"held": F.coalesce("held", none)})
    extra = F.coalesce(F.col("kind") == "extra_text", F.lit(False))
    d = d.withColumn("excluded", F.when(extra, F.coalesce("excluded", none)).otherwise(none)).withColumn("extra_ids", F.coalesce("extra_ids", none))
    n = F.col("n")
    keep = (F.col("same") == n) & (F.col("before") == n) & (F.col("signed") == n) & same_multiset(F.concat("held", "excluded"), F.col("chars"))
    d = d.withColumn("keep", keep)
    d = d.withColumn("ids", F.col("keep") & (F.col("named") == n) & (F.size("extra_ids") == F.size("excluded")))
    fits = (F.size("chars") == n) & (n > 0)
    d = d.withColumn("how", F.when(F.col("keep"), "keep").when(fits, "fit").when(F.col("kind").isin("missing_text", "extra_text"), F.col("kind")))
    rows = both.join(d, group)
    dealt = F.get("chars", F.col("pos") - 1)
    token = F.when(F.col("how") == "keep", F.col("__token")).when(F.col("how") == "missing_text", F.coalesce(dealt, F.lit(MISSING))).when(F.col("how").isNotNull(), dealt)
    name = F.when(F.col("ids"), F.col("__id")).otherwise(F.col("pos").cast("string"))
    rows = rows.select(group, "pos", "uid", token.alias("token"), F.when(token.isNotNull(), name).alias("token_id"))
    rest = F.when(F.col("how") == "keep", F.col("excluded")).when(F.col("how") == "extra_text", F.slice("chars", n.cast("int") + 1, F.size("chars"))).otherwise(none)
    tail = d.select(group, "n", "ids", "extra_ids", F.posexplode(rest).alias("i", "token"))
    pos = (F.col("n") + F.col("i") + 1).cast(order.schema["pos"].dataType)
    late = F.when(F.col("ids"), F.get("extra_ids", "i")).otherwise(pos.cast("string"))
    return rows.unionByName(tail.select(group, pos.alias("pos"), F.lit(None).cast(order.schema["uid"].dataType).alias("uid"), "token", late.alias("token_id")))


def resequenced(current: DataFrame, wanted: DataFrame, group: str = "image") -> DataFrame:
    """(group, pos, token, token_id, accepted): current(group, pos, token, token_id) in the order of wanted(group, pos, token). Of equal signs, each takes the id of the first that
    is left. A sequence is accepted if it has the signs that are there, each as often; of another group all stays as it was."""
    place = F.col("pos")
    both = match_once(wanted.select(group, "token", place), current.select(group, "token", place.alias("__at"), "token_id"), [group, "token"], [place], [F.col("__at")], "full")
    ok = both.groupBy(group).agg((F.count_if(F.col("pos").isNull() | F.col("__at").isNull()) == 0).alias("accepted"))
    new = both.select(group, "pos", "token", "token_id").join(ok.where("accepted"), group)
    return new.unionByName(current.select(group, "pos", "token", "token_id").join(ok.where("not accepted"), group))


def replaced_statuses(boxes: DataFrame, update: DataFrame, group: str = "image", uid: str = "uid") -> DataFrame:
    """boxes(group, uid, status, damage_level, flags, token) after an update of the same columns, where null flags stay, with ``accepted``.

    An update counts for a group as a whole: it must name every box once, with a status and a level from 1 to 3 or none; otherwise the group stays as it was. A flag
    that is newly set displaces those that it can't stand with; levels and unknown need damage; a sign that stands for something sets or clears the flags."""
    named = ["status", "damage_level", *FLAGS]
    u = update.select(group, uid, *[F.col(c).alias(f"__{c}") for c in named], F.lit(1).alias("__u"))
    both = boxes.withColumn("__b", F.lit(1)).join(u, [group, uid], "full")
    level = F.col("__damage_level")
    fine = F.col("__b").isNotNull() & F.coalesce(F.col("__status").isin("damaged", "intact"), F.lit(False)) & (level.isNull() | level.between(1, 3))
    repeated = update.groupBy(group, uid).agg((F.count("*") > 1).alias("r")).groupBy(group).agg(F.max("r").alias("__r"))
    told = both.groupBy(group).agg(F.min(F.coalesce(fine, F.lit(False))).alias("__ok"), F.max("__u").alias("__u")).join(repeated, group, "left")
    told = told.select(group, (F.col("__ok") & ~F.coalesce("__r", F.lit(True))).alias("accepted"), F.col("__u").isNotNull().alias("__any"))
    once = boxes.join(told.where("accepted"), group).join(u.drop("__u"), [group, uid])
    old = once.withColumnsRenamed({c: f"old_{c}" for c in named}).withColumn("new_status", F.col("__status"))
    new = updated_flags(old.withColumns({f"new_{f}": F.coalesce(f"__{f}", f"old_{f}") for f in FLAGS})).withColumn("status", F.col("__status"))
    sign = F.coalesce("token", F.lit(""))
    unknown, no_font, miss = sign == UNKNOWN, sign == NO_FONT, sign == MISSING
    hurt: Column = damaged(F.col("status")) | unknown
    out = {"status": F.when(unknown, "damaged").otherwise(F.col("status")), "damage_level": F.when(hurt, F.col("__damage_level")), "unknown": unknown | (F.col("unknown") & hurt & ~no_font & ~miss)}
    out |= {f: F.col(f) & ~unknown & ~miss for f in OTHERS}
    out["unavailable_font"] = (F.col("unavailable_font") | no_font) & ~unknown & ~miss
    new = new.withColumns(out).select(*boxes.columns, "accepted")
    return new.unionByName(boxes.join(told.where("not accepted").select(group, "accepted"), group).select(*boxes.columns, "accepted"))
