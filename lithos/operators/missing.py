"""Planner of missing pictures: which picture on which page shows which requested face."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from .relational import interval_join, running_sum

#: A place in a volume as one number: page times this plus y in hundredths of a point.
PAGE = 1_000_000


def requested(report: DataFrame) -> DataFrame:
    """Distinct normalised ids of report(missing_ids, groups array<struct<missing_ids>>)."""
    top = report.select(F.explode("missing_ids").alias("id"))
    low = report.select(F.explode("groups").alias("g")).select(F.explode("g.missing_ids").alias("id"))
    return top.unionByName(low).select(normalize_key(F.col("id")).alias("id")).where("id is not null").distinct()


def place(page, y):
    """A long: as an integer it would end at page 2147."""
    return page.cast("long") * PAGE + F.round(y * 100).cast("long")


def inscriptions(lines: DataFrame, title: str, label: str, page_count: int) -> DataFrame:
    """(volume, rec, ids, start, end): ids of the first labelled line and of the lines of digits and separators after it while the
    value is empty or ends in / , or ;, in order and with repeats. An inscription ends where the next one starts. A volume may be of
    any length: its titles are counted by blocks of lines, and all else happens inside a record."""
    text = F.col("text")
    l = lines.select("volume", "line_no", "text", text.rlike(title).alias("first"), text.rlike(label).alias("opens"), text.rlike("^[0-9\\s/.,;–-]+$").alias("digits"), place(F.col("page_number"), F.col("y0")).alias("at"))  # noqa: E741
    value = F.when(F.col("opens"), F.regexp_replace("text", label, "")).when(F.col("digits"), text)
    # a line of white space leaves the value as it was
    goes_on = F.coalesce(F.rtrim("value").rlike("(^|[/,;])$"), F.lit(False))
    l = l.select("volume", "line_no", F.col("first").cast("int").alias("first"), "opens", "digits", value.alias("value"), F.when(F.col("first"), F.col("at")).alias("at")).withColumn("goes_on", goes_on)  # noqa: E741
    l = running_sum(l, "volume", "line_no", "first").withColumnRenamed("so_far", "rec").where("rec > 0")  # noqa: E741
    # a title is the last line of the record before it as well, and tells its end
    l = l.withColumn("turn", F.explode(F.when(F.col("first") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))  # noqa: E741
    own = F.col("turn") == 0
    flags = [F.when(own, F.col(c)).otherwise(F.lit(False)).alias(c) for c in ("opens", "digits", "goes_on")]
    l = l.select("volume", (F.col("rec") - F.col("turn")).alias("rec"), "line_no", "first", *flags, F.when(own, F.col("value")).alias("value"), F.when(own, F.col("at")).alias("start"), F.when(~own, F.col("at")).alias("end")).where("rec > 0")  # noqa: E741
    rec = Window.partitionBy("volume", "rec").orderBy("line_no")
    seen = rec.rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("label_no", F.min(F.when(F.col("opens"), F.col("line_no"))).over(seen)).withColumn("before", F.coalesce(F.lag("goes_on").over(rec), F.lit(False)))  # noqa: E741
    stops = (F.col("line_no") > F.col("label_no")) & ~(F.col("digits") & F.col("before"))
    l = l.withColumn("stopped", F.coalesce(F.max(stops).over(seen), F.lit(False)))  # noqa: E741
    part = (F.col("line_no") >= F.col("label_no")) & ~F.col("stopped")
    l = l.withColumn("part", F.coalesce(part, F.lit(False))).where("part or first = 1")  # noqa: E741
    got = l.groupBy("volume", "rec").agg(F.array_sort(F.collect_list(F.when(F.col("part"), F.struct("line_no", F.col("value").alias("t"))))).alias("v"), F.min("start").alias("start"), F.min("end").alias("end"))
    ids = F.transform(F.regexp_extract_all(F.array_join(F.transform("v", lambda x: x["t"]), " "), F.lit("[0-9]+"), 0), lambda i: normalize_key(i))
    return got.select("volume", "rec", "start", F.coalesce("end", F.lit((page_count + 1) * PAGE)).alias("end"), ids.alias("ids"))


def faces_of(records: DataFrame, pictures: DataFrame) -> DataFrame:
    """(volume, rec, pos, page, idx, …): pictures(volume, idx, page, y0, y1, …) in the records(volume, rec, start, end) that hold them, numbered
    from 1 by their place. On its last page a picture must end above the next record."""
    pics = pictures.withColumn("at", place(F.col("page"), F.col("y0")))
    inside = interval_join(pics, records.select("volume", "rec", "start", "end"), "volume", PAGE)
    if "y1" in pictures.columns:
        inside = inside.where((F.col("page") < F.floor(F.col("end") / PAGE)) | (place(F.col("page"), F.col("y1")) <= F.col("end")))
    return inside.withColumn("pos", F.row_number().over(Window.partitionBy("volume", "rec").orderBy("at", "idx"))).drop("at", "start", "end")


def plan(wanted: DataFrame, records: DataFrame, pictures: DataFrame, overrides: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(id, status, page, idx) for wanted(id), records of ``inscriptions`` and pictures(volume, idx, page, y0, …).

    An id is planned if it stands in one record, whose ids differ from each other and are as many as its pictures: the
    pictures are taken in order. Otherwise it needs review; without any record it is not found. An
    override(id, page, idx) wins. If ``errors`` has any row, a volume could not be read, so an id may stand there
    too: what was planned needs review. Pictures meet records by a binned interval join.
    """
    inside = faces_of(records, pictures)
    n = inside.groupBy("volume", "rec").agg(F.count("*").alias("n_pics"))
    named = records.select("volume", "rec", (F.size("ids") == F.size(F.array_distinct("ids"))).alias("differ"), F.size("ids").alias("n_ids"), F.posexplode("ids").alias("p", "id")).withColumn("pos", F.col("p") + 1)
    opts = wanted.select("id").distinct().join(named, "id", "left").join(n, ["volume", "rec"], "left").join(inside.select("volume", "rec", "pos", "page", "idx"), ["volume", "rec", "pos"], "left")
    opts = opts.withColumn("exact", F.col("differ") & (F.col("n_ids") == F.col("n_pics")))
    out = opts.groupBy("id").agg(F.count_distinct("volume", "rec").alias("n"), F.min("exact").alias("exact"), F.min("page").alias("page"), F.min("idx").alias("idx"))
    status = F.when(F.col("n") == 0, "not_found").when((F.col("n") == 1) & F.coalesce("exact", F.lit(False)), "planned").otherwise("needs_review")
    out = out.withColumn("status", status)
    if overrides is not None:
        o = overrides.select("id", F.col("page").alias("__p"), F.col("idx").alias("__i"))
        out = out.join(o, "id", "left").withColumn("status", F.when(F.col("__p").isNotNull(), "planned").otherwise(F.col("status"))).withColumn("page", F.coalesce("__p", "page")).withColumn("idx", F.coalesce("__i", "idx"))
    if errors is not None:
        some = errors.limit(1).agg((F.count("*") > 0).alias("__e"))  # one row
        out = out.join(F.broadcast(some), F.lit(True)).withColumn("status", F.when(F.col("__e") & (F.col("status") == "planned"), "needs_review").otherwise(F.col("status")))
    ok = F.col("status") == "planned"
    return out.select("id", "status", F.when(ok, F.col("page")).alias("page"), F.when(ok, F.col("idx")).alias("idx"))


def plan_record(ids: list[str], records: DataFrame, pictures: DataFrame, pages: tuple[int, int]) -> DataFrame:
    """(id, page, idx) for a record whose pages are known: the pictures from the first to the last page are taken in order. As many as
    the ids they must be; otherwise, or where no record names these ids in this order, it is an error."""
    spark = records.sparkSession
    named = records.where(F.col("ids") == F.array(*[F.lit(i) for i in ids])).agg(F.count("*").alias("n"))
    here = pictures.where(F.col("page").between(*pages)).withColumn("pos", F.row_number().over(Window.orderBy("page", "y0", "idx")))
    told = here.agg(F.count("*").alias("m")).join(named, F.lit(True)).select(
        F.when(F.col("n") != 1, F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" records have these ids")))).when(F.col("m") != len(ids), F.raise_error(F.concat(F.col("m").cast("string"), F.lit(" pictures")))).otherwise(F.lit(True)).alias("ok")
    )
    wanted = spark.createDataFrame(list(enumerate(ids, 1)), "pos int, id string")
    return wanted.join(F.broadcast(told), F.col("ok")).join(here, "pos").select("id", "page", "idx")


#: Statuses of candidates, the one that counts first.
STATUS_ORDER = ("needs_review", "extracted", "planned", "already_exists", "not_found")


def rollup(candidates: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    """One status per id: the first of its candidates' in STATUS_ORDER."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col(status))
    r = candidates.groupBy(key).agg(F.min(rank).alias("r"))
    return r.select(key, F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("r").cast("int")).alias(status))
