"""Joins, winners, set checks and ordinal operators; column names are parameters throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING, normalize_key


def winners(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_faces(faces: DataFrame, priority: str = "priority", seq: str = "seq", key: str = "face_key", record: str = "record_id", volume: str = "volume") -> DataFrame:
    """Winning face of each (volume, key): greatest priority, of equal ones the latest. face_pos orders the
    faces of a record by where their key was first met, whichever file that was in."""
    first = F.min(seq).over(Window.partitionBy(volume, key))
    return winners(faces.withColumn("first_seq", first), [volume, key], [F.desc(priority), F.desc(seq)])


def regroup(won: DataFrame, record: str = "record_id", number: str = "number", volume: str = "volume", key: str = "face_key") -> DataFrame:
    """Winning faces as records: (volume, record, number, faces), records numbered by their number, nulls last."""
    faces = won.groupBy(volume, record, number).agg(F.array_sort(F.collect_list(F.struct("first_seq", key))).alias("f"), F.min("first_seq").alias("first_seq"))
    place = F.row_number().over(Window.partitionBy(volume).orderBy(F.col(number).isNull(), F.col(number), "first_seq"))
    return faces.select(volume, record, number, F.transform("f", lambda x: x[key]).alias("faces"), place.alias("position"))


def lookup(images: DataFrame, faces: DataFrame, image: str = "image_code", key: str = "face_key") -> DataFrame:
    """Faces of each image code: exact matches; only where there is none and the code is all digits, those
    of the code without leading zeros. match_count other than 1 is an error of the data."""
    right = faces.select(F.col(key).alias("__k")).groupBy("__k").agg(F.count("*").alias("__n"))
    stripped = F.when(F.col(image).rlike("^[0-9]+$"), normalize_key(F.col(image), strip=False))
    out = images.withColumn("__s", stripped)
    out = out.join(right.withColumnsRenamed({"__k": "__k1", "__n": "__n1"}), F.col(image) == F.col("__k1"), "left")
    out = out.join(right.withColumnsRenamed({"__k": "__k2", "__n": "__n2"}), F.col("__s") == F.col("__k2"), "left")
    found = F.coalesce("__k1", "__k2")
    return out.withColumns({"matched": found, "match_count": F.coalesce("__n1", "__n2", F.lit(0)).cast("long")}).drop("__s", "__k1", "__k2", "__n1", "__n2")


def match_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of right for each key of left, keys normalised on both sides."""
    a = left.select(normalize_key(F.col(left_key)).alias("key")).where("key is not null").distinct()
    b = right.select(normalize_key(F.col(right_key)).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return a.join(b, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))


def duplicates(df: DataFrame, keys: list[str], locations: str | None = None) -> DataFrame:
    """Keys that occur more than once, with their count and, sorted, their locations."""
    aggs = [F.count("*").alias("n")]
    if locations:
        aggs.append(F.array_sort(F.collect_list(locations)).alias("locations"))
    return df.groupBy(*keys).agg(*aggs).where("n > 1")


def without_errors(records: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Records whose number has no issue with errors; warnings alone don't drop a record."""
    return records.join(issues.where(F.size("errors") > 0).select(key).distinct(), key, "left_anti")


def declared_or_found(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of declared and found keys, null keys being equal, with a flag for each side."""
    a = declared.select(*keys).distinct().withColumn("__d", F.lit(True))
    b = found.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__f", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    out = a.join(b, cond, "full")
    return out.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.coalesce("__d", F.lit(False)).alias("declared"), F.coalesce("__f", F.lit(False)).alias("found"))


def align(tokens: DataFrame, boxes: DataFrame, group: str, position: str = "pos", pad: str | None = None) -> DataFrame:
    """Tokens and boxes joined by place in their group. Boxes without a token get ``pad`` or stay null;
    tokens beyond the boxes come out with a null box (``excluded``)."""
    t = tokens.withColumn("__t", F.lit(True))
    b = boxes.withColumn("__b", F.lit(True))
    out = t.join(b, [group, position], "full")
    token = F.coalesce("token", F.lit(pad)) if pad is not None else F.col("token")
    return out.withColumn("token", F.when(F.col("__t").isNull(), token).otherwise(F.col("token"))).withColumn("excluded", F.col("__b").isNull()).drop("__t", "__b")


def align_rows(df: DataFrame, group: str, position: str = "pos") -> DataFrame:
    """``align`` for groups that are rows (group, tokens array, boxes array): both are in order, so nothing is exchanged. A null array is empty."""
    n = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("tokens", "boxes")])
    have = F.coalesce(F.size("boxes"), F.lit(0))
    rows = df.withColumn("__at", F.when(n > 0, F.sequence(F.lit(0), n - 1))).select(group, "tokens", "boxes", have.alias("__have"), F.explode("__at").alias("__i"))
    return rows.select(group, (F.col("__i") + 1).alias(position), F.get("tokens", "__i").alias("token"), F.get("boxes", "__i").alias("box"), (F.col("__i") >= F.col("__have")).alias("excluded"))


def align_missing(tokens: DataFrame, boxes: DataFrame, group: str, position: str = "pos") -> DataFrame:
    return align(tokens, boxes, group, position, MISSING)


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """Numbers equal keys from 1, so that joins on key and number match each row once."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def match_once(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], how: str = "left") -> DataFrame:
    """Join in which equal keys on both sides are used up in order, each row once."""
    a, b = occurrence(left, keys, left_order), occurrence(right, keys, right_order)
    return a.join(b, [*keys, "occurrence"], how)


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)  # array_sort compares by an interpreted function


def order_problems(df: DataFrame, group: str, order: str) -> DataFrame:
    """For each group of n rows whether its orders are exactly 1..n: missing, repeated and null orders."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(order).isNull()).alias("n_unassigned"), F.array_sort(F.collect_set(order)).alias("have"))
    rep = df.where(F.col(order).isNotNull()).groupBy(group, order).agg(F.count("*").alias("c")).where("c > 1").groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("repeated"))
    gone = F.array_except(F.sequence(F.lit(1), F.col("n").cast("int")), F.transform("have", lambda x: x.cast("int")))
    out = g.join(rep, group, "left")
    return out.select(group, "n", "n_unassigned", gone.alias("missing"), F.when(F.col("repeated").isNull(), 0).otherwise(F.size("repeated")).alias("n_repeated"))


def islands(df: DataFrame, group: str, number: str) -> DataFrame:
    """Runs of consecutive integers: (group, first, last, length)."""
    d = df.select(group, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(group).orderBy(number))
    return d.withColumn("__r", run).groupBy(group, "__r").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("__r")


def ranges_text(df: DataFrame, group: str, number: str, most: int = 4) -> DataFrame:
    """(group, ranges): the runs of a group's distinct numbers in words, like ``1–3, 7``; of more than ``most`` runs the first and last two."""
    runs = islands(df, group, number).withColumn("t", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string"))))
    parts = runs.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]).alias("p"))
    short = F.concat(F.slice("p", 1, 2), F.array(F.lit("…")), F.slice("p", -2, 2))
    return parts.select(group, F.array_join(F.when(F.size("p") > most, short).otherwise(F.col("p")), ", ").alias("ranges"))


def assign_range(df: DataFrame, group: str, selected: str, order: list[Column], start: str, current: str) -> DataFrame:
    """Selected rows get start, start + 1, …; conflict marks new orders that unselected rows hold."""
    w = Window.partitionBy(group, selected).orderBy(*order)
    out = df.withColumn("new_order", F.when(F.col(selected), F.col(start) + F.row_number().over(w) - 1))
    held = df.where(~F.col(selected)).select(F.col(group).alias("__g"), F.col(current).alias("__o")).distinct()
    return out.join(held, (F.col(group) == F.col("__g")) & (F.col("new_order") == F.col("__o")), "left").withColumn("conflict", F.col("__o").isNotNull()).drop("__g", "__o")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row of each key; rows keep the place at which their key was first inserted."""
    both = old.unionByName(new)
    first = F.min(seq).over(Window.partitionBy(key))
    return winners(both.withColumn("first_seq", first), [key], [F.desc(seq)])


#: Numbers of one block, where a group is dealt to many tasks by its order.
BLOCK = 1 << 16


def running_sum(df: DataFrame, group: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Adds so_far: ``value`` summed from the first row of a group to this one, in the order of a column of integers. No task holds a
    whole group: its blocks are summed first, and what lies before a block takes part in it as its first row."""
    d = df.withColumn("__block", F.floor(F.col(order) / block))
    earlier = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(group, "__block").agg(F.sum(value).alias("__s")).select(group, "__block", F.sum("__s").over(earlier).alias(value))
    both = d.withColumn("__own", F.lit(True)).unionByName(before.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(group, "__block").orderBy("__own", order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("so_far", F.sum(value).over(upto)).where("__own").drop("__own", "__block")


#: Rows of one array, where rows that agree in a key are packed.
PACK = 128


def packed(df: DataFrame, keys: list[str], name: str, pack: int = PACK) -> DataFrame:
    """(keys, ``name``): the other columns of rows that agree in ``keys``, as arrays of at most ``pack`` structs; of plain values, if it is one column."""
    others = [c for c in df.columns if c not in keys]
    rows = F.collect_list(F.struct(*others) if others else F.lit(True))
    rows = F.transform(rows, lambda r: r[others[0]]) if len(others) == 1 else rows
    part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1) / pack)
    return df.withColumn("__part", part).groupBy(*keys, "__part").agg(rows.alias(name)).drop("__part")


def interval_join(points: DataFrame, spans: DataFrame, group: str, width: int, point: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Points in half-open spans. Spans are dealt to bins of ``width``, so the join has an equality key; a
    span is copied once for each bin that it meets. Both sides are dealt by that key: were the spans broadcast, a small file of
    points would be joined by one task, however many pairs it gives. Points of one place and spans of one extent meet as arrays, which
    are compared once and give the pairs in runs: these take little space where they are written."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    a = points.withColumn("__bin", F.floor(F.col(point) / width)).repartition(group, "__bin")
    b = spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(bins)).repartition(group, "__bin")
    a = packed(a, [group, "__bin", point], "__points")
    b = packed(b, [group, "__bin", start, end], "__spans").withColumnRenamed(group, "__g").withColumnRenamed("__bin", "__b")
    pairs = a.join(b.hint("merge"), (a[group] == b["__g"]) & (a["__bin"] == b["__b"]) & (a[point] >= b[start]) & (a[point] < b[end]))
    each = pairs.withColumn("__p", F.explode("__points")).withColumn("__s", F.explode("__spans"))

    def of(df: DataFrame, at: str, keys: tuple[str, ...]) -> list[Column]:
        lone = len(set(df.columns) - set(keys)) == 1
        return [F.col(c) if c in keys else F.col(at if lone else f"{at}.`{c}`").alias(c) for c in df.columns]

    return each.select(*of(points, "__p", (group, point)), *[c for c, n in zip(of(spans, "__s", (group, start, end)), spans.columns) if n != group])
