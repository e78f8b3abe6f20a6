"""Ordered lines to nested records: titles, metadata, sections, face markers, checks.

Lines carry their order in ``line_no``. Finding the titles needs the lines of a volume in order; all
later windows are by record, of which there are many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, label_key, label_remainder, plain_label_key


@dataclass(frozen=True)
class Field:
    label: str
    name: str
    type: str = "string"  # or identifiers
    required: bool = False


@dataclass(frozen=True)
class RecordFormat:
    """Patterns are Java regular expressions. title has one group, the number; marker has two, the face's
    id and what follows."""

    title: str
    start: str
    sections: tuple[str, ...]
    fields: tuple[Field, ...]
    marker: str = "^\\s*<\\s*(\\d+)\\s*>?\\s*(.*)$"
    consecutive: bool = True

    def label_keys(self) -> dict[str, str]:
        labels = list(dict.fromkeys([self.start, *self.sections, *[f.label for f in self.fields]]))
        return {x: plain_label_key(x.rstrip(":")) for x in labels}


def number_records(lines: DataFrame, title: str, volume: str = "volume", order: str = "line_no", text: str = "text") -> DataFrame:
    """lines from the first title on, with rec (from 1) and is_title; earlier lines are dropped."""
    w = Window.partitionBy(volume).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(text).rlike(title).cast("int")
    return lines.withColumn("is_title", hit == 1).withColumn("rec", F.sum(hit).over(w)).where("rec > 0")


def carry(value: Column, keys: list[str], order: str = "line_no") -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def cut_footnotes(lines: DataFrame, pattern: str, largest: float, page: list[str], order: list[Column], text: str = "text", size: str = "font_size") -> DataFrame:
    """Drops on each page the first line that opens a footnote, and all lines after it."""
    w = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col(text).rlike(pattern) & (F.col(size) <= largest)).cast("int")
    return lines.withColumn("__f", F.max(opens).over(w)).where("__f = 0").drop("__f")


def inside_margins(lines: DataFrame, height: Column, top: float, bottom: float) -> DataFrame:
    return lines.where(~((F.col("y0") < top) | (F.col("y1") > height - bottom)))


def consecutive(titles: DataFrame, volume: str = "volume", number: str = "number", order: str = "line_no") -> DataFrame:
    """(volume, n, first, repeated, consecutive) of the record numbers of each volume."""
    w = Window.partitionBy(volume).orderBy(order)
    t = titles.withColumn("__d", F.col(number) - F.row_number().over(w))
    return t.groupBy(volume).agg(F.count("*").alias("n"), F.min_by(number, order).alias("first"), (F.count_distinct(number) < F.count("*")).alias("repeated"), (F.count_distinct("__d") == 1).alias("consecutive"))


def section_texts(content: DataFrame, keys: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """Lines of each group joined by line breaks, in order, stripped; first_no orders the groups."""
    rows = content.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("__l"), F.min(order).alias("first_no"))
    joined = F.array_join(F.transform("__l", lambda x: x[text]), "\n")
    return rows.select(*keys, "first_no", F.regexp_replace(joined, "^\\s+|\\s+$", "").alias("body"))


def parse_records(lines: DataFrame, fmt: RecordFormat, details: bool = True) -> DataFrame:
    """lines(volume, line_no, text, page_number) -> one row per record: (volume, rec, number, pages,
    metadata map, ids, faces, errors, warnings, lines). A record whose metadata can't be read has errors
    and null faces, and its source lines stand in ``lines``; others are not affected. Without ``details`` warnings come without texts, which then
    are collected nowhere."""
    keys = fmt.label_keys()
    rec = ["volume", "rec"]
    # Python loses how rows are dealt, so it comes first
    base = number_records(lines.withColumn("head", label_key(F.substring_index("text", ":", 1))), fmt.title)
    number = F.regexp_extract("text", fmt.title, 1).cast("int")
    told = lambda c: c if details else F.lit(None).cast("string")
    remainder = lambda label: label_remainder(F.col("text"), F.col("head"), label, keys[label])

    base = base.withColumn("rest", F.when(~F.col("is_title"), remainder(fmt.start)))
    base = base.withColumn("start_no", F.min(F.when(F.col("rest").isNotNull(), F.col("line_no"))).over(Window.partitionBy(*rec)))
    heads = base.groupBy(*rec).agg(
        F.max(F.when(F.col("is_title"), number)).alias("number"), F.array_sort(F.collect_set("page_number")).alias("pages"),
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("__src"), F.max("start_no").isNotNull().alias("has_start"),
    )
    body = base.where("not is_title")

    # metadata: the longest label that fits opens a field, and lines without one go on with it
    meta = body.where(F.col("start_no").isNull() | (F.col("line_no") < F.col("start_no")))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in sorted(fmt.fields, key=lambda f: len(f.label)):
        got = remainder(f.label)
        name, value = F.when(got.isNotNull(), f.name).otherwise(name), F.when(got.isNotNull(), got).otherwise(value)
    meta = meta.withColumn("opens", name).withColumn("value", value)
    meta = meta.withColumn("field", carry(F.col("opens"), rec)).withColumn("value", F.when(F.col("opens").isNotNull(), F.col("value")).otherwise(F.col("text")))
    stray = meta.where("field is null").select(*rec, F.struct("line_no", F.lit("before_metadata").alias("kind"), F.col("page_number").alias("page"), F.lit(None).cast("string").alias("face"), told(F.col("text")).alias("detail")).alias("w"))
    fields = meta.where("field is not null and value <> ''").groupBy(*rec, "field").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("v"))
    fields = fields.select(*rec, F.struct("field", F.trim(F.array_join(F.transform("v", lambda x: x["value"]), " ")).alias("value")).alias("kv"))
    fields = fields.groupBy(*rec).agg(F.map_from_entries(F.collect_list("kv")).alias("found"))

    records = heads.join(fields, rec, "left")
    get = lambda n: F.coalesce(F.try_element_at("found", F.lit(n)), F.lit(""))
    ids = F.array_distinct(F.flatten(F.array(*[identifiers(get(f.name)) for f in fmt.fields if f.type == "identifiers"] or [F.expr("cast(array() as array<string>)")])))
    errors = [F.when(~F.col("has_start"), F.lit(f"missing heading {fmt.start}"))]
    for f in fmt.fields:
        if f.required:
            errors.append(F.when(F.col("has_start") & (get(f.name) == ""), F.lit(f"missing metadata {f.label}")))
            if f.type == "identifiers":
                errors.append(F.when(F.col("has_start") & (get(f.name) != "") & (F.size(identifiers(get(f.name))) == 0), F.lit(f"unreadable identifiers {f.label}")))
    records = records.withColumn("metadata", F.create_map(*[x for f in fmt.fields for x in (F.lit(f.name), get(f.name))])).withColumn("ids", ids)
    records = records.withColumn("fatal", F.array_compact(F.array(*errors))).drop("found", "has_start")

    # content: what follows the start heading on its line is the first content line
    content = body.where(F.col("line_no") > F.col("start_no")).select(*rec, "line_no", "page_number", "text", "head")
    first = body.where((F.col("line_no") == F.col("start_no")) & (F.col("rest") != "")).select(*rec, "line_no", "page_number", F.col("rest").alias("text"), label_key(F.substring_index("rest", ":", 1)).alias("head"))
    content = content.unionByName(first).join(records.where(F.size("fatal") == 0).select(*rec, "ids"), rec)
    opens = F.lit(None).cast("string")
    for label in reversed(fmt.sections):
        opens = F.when(remainder(label) == "", F.lit(label)).otherwise(opens)
    order = Window.partitionBy(*rec).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    content = content.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").isNotNull().cast("int")).over(order))
    content = content.withColumn("section", F.coalesce(carry(F.col("opens"), rec), F.lit(fmt.start))).where("opens is null")
    content = content.withColumn("mark", F.when(F.col("text").rlike(fmt.marker), F.regexp_extract("text", fmt.marker, 1)))
    bare = lambda c: F.when(F.regexp_replace(c, "^0+", "") == "", "0").otherwise(F.regexp_replace(c, "^0+", ""))
    same = F.get(F.filter("ids", lambda i: bare(i) == bare(F.col("mark"))), F.lit(0))
    content = content.withColumn("mark_id", F.when(F.array_contains("ids", F.col("mark")), F.col("mark")).otherwise(F.coalesce(same, "mark")))
    content = content.withColumn("face", carry(F.col("mark_id"), [*rec, "run"]))
    content = content.withColumn("line", F.when(F.col("mark").isNotNull(), F.trim(F.regexp_extract("text", fmt.marker, 2))).otherwise(F.col("text")))
    known = F.array_contains("ids", F.col("face"))
    unknown = content.where(F.col("mark_id").isNotNull() & ~F.array_contains("ids", F.col("mark_id"))).groupBy(*rec, "mark_id").agg(F.min_by(F.struct("line_no", F.lit("unknown_marker").alias("kind"), F.col("page_number").alias("page"), F.col("mark_id").alias("face"), told(F.col("text")).alias("detail")), "line_no").alias("w")).select(*rec, "w")
    lines_ = content.where("not (mark is not null and line = '')").withColumn("known", F.coalesce(known, F.lit(False)))
    texts = section_texts(lines_.select(*rec, "face", "section", "line_no", F.col("line").alias("text")), [*rec, "face", "section"])
    loose = lines_.where("face is null").groupBy(*rec, "section").agg(F.min("line_no").alias("line_no"), F.min("page_number").alias("page"), F.array_sort(F.collect_list(F.struct("line_no", F.col("line").alias("t")))).alias("l"))
    loose = loose.select(*rec, F.struct("line_no", F.lit("unmarked_content").alias("kind"), "page", F.lit(None).cast("string").alias("face"), told(F.concat_ws("\n", F.col("section"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))).alias("detail")).alias("w"))
    faces = texts.groupBy(*rec, "face").agg(F.array_sort(F.collect_list(F.struct("first_no", F.col("section").alias("title"), "body"))).alias("s"), F.min("first_no").alias("first_no"))
    faces = faces.select(*rec, F.struct("first_no", F.col("face").alias("id"), F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("text"))).alias("sections")).alias("f"))
    faces = faces.groupBy(*rec).agg(F.array_sort(F.collect_list("f")).alias("have"))
    warns = stray.unionByName(unknown).unionByName(loose).groupBy(*rec).agg(F.array_sort(F.collect_list("w")).alias("w"))

    out = records.join(faces, rec, "left").join(warns, rec, "left")
    none = F.expr("cast(array() as array<struct<first_no: int, id: string, sections: array<struct<title: string, text: string>>>>)")
    out = out.withColumn("have", F.coalesce("have", none))
    face = lambda i: F.get(F.filter("have", lambda f: f["id"] == i), F.lit(0))
    empty = F.expr("cast(array() as array<struct<title: string, text: string>>)")
    declared = F.transform("ids", lambda i: F.struct(i.alias("id"), F.coalesce(face(i)["sections"], empty).alias("sections")))
    extra = F.transform(F.filter("have", lambda f: f["id"].isNull() | ~F.array_contains("ids", f["id"])), lambda f: F.struct(f["id"].alias("id"), f["sections"].alias("sections")))
    ok = F.size("fatal") == 0
    out = out.withColumn("faces", F.when(ok, F.concat(declared, extra)))
    start_text = lambda f: F.filter(f["sections"], lambda s: s["title"] == fmt.start)
    lacking = F.transform(F.filter("faces", lambda f: F.array_contains("ids", f["id"]) & ~((F.size(start_text(f)) == 1) & (F.trim(F.get(start_text(f), F.lit(0))["text"]) != ""))), lambda f: F.concat(F.lit("face <"), f["id"], F.lit(f"> lacks {fmt.start}")))
    quiet = F.transform(F.filter("faces", lambda f: F.array_contains("ids", f["id"]) & (F.size(f["sections"]) == 0)), lambda f: F.struct(F.lit("empty_marker").alias("kind"), F.lit(None).cast("int").alias("page"), f["id"].alias("face"), F.lit("").alias("detail")))
    seen = F.transform("w", lambda x: F.struct(x["kind"].alias("kind"), x["page"].cast("int").alias("page"), x["face"].alias("face"), x["detail"].alias("detail")))
    no_warn = F.expr("cast(array() as array<struct<kind: string, page: int, face: string, detail: string>>)")
    return out.select(
        *rec, "number", "pages", "metadata", "ids", "faces",
        F.when(ok, lacking).otherwise(F.col("fatal")).alias("errors"),
        F.concat(F.coalesce(seen, no_warn), F.coalesce(quiet, no_warn)).alias("warnings"),
        F.transform("__src", lambda x: x["text"]).alias("lines"),
    )


def sequence_issues(records: DataFrame, fmt: RecordFormat) -> DataFrame:
    """(volume, number null, errors) for volumes whose record numbers repeat or, where asked for, have gaps."""
    c = consecutive(records, order="rec")
    bad = F.array_compact(F.array(F.when(F.col("repeated"), F.lit("repeated numbers")), F.when(~F.col("consecutive") & F.lit(fmt.consecutive), F.lit("numbers are not consecutive"))))
    return c.select("volume", F.lit(None).cast("int").alias("number"), bad.alias("errors")).where(F.size("errors") > 0)


def split_output(records: DataFrame, fmt: RecordFormat) -> tuple[DataFrame, DataFrame]:
    """(primary records, issues): records without errors under any record of their number, and all that
    has errors or warnings, with sequence violations under a null number."""
    issues = records.where((F.size("errors") > 0) | (F.size("warnings") > 0)).select("volume", "number", "pages", "errors", "warnings", "lines")
    seq = sequence_issues(records, fmt).select("volume", "number", F.lit(None).cast("array<int>").alias("pages"), "errors", F.lit(None).cast(issues.schema["warnings"].dataType).alias("warnings"), F.lit(None).cast("array<string>").alias("lines"))
    bad = records.where(F.size("errors") > 0).select("volume", "number").distinct()
    return records.join(bad, ["volume", "number"], "left_anti"), issues.unionByName(seq)


class ParseError(ValueError):
    """A volume has a record that can't be parsed, or record numbers that don't fit."""


def first_errors(records: DataFrame, fmt: RecordFormat) -> DataFrame:
    """(volume, error): what strict parsing of a volume would stop at. Errors of the numbering come first, then
    those of the first record that has any; volumes without errors are left out."""
    seq = sequence_issues(records, fmt).select("volume", F.lit(0).cast("long").alias("rec"), F.get("errors", F.lit(0)).alias("error"))
    own = records.where(F.size("errors") > 0).select("volume", F.col("rec").cast("long").alias("rec"), F.get("errors", F.lit(0)).alias("error"))
    return seq.unionByName(own).groupBy("volume").agg(F.min_by("error", F.struct("rec", "error")).alias("error"))


def parse_strict(lines: DataFrame, fmt: RecordFormat) -> DataFrame:
    """The records of parse_records if no volume has an error; else ParseError with the first volume's."""
    records = parse_records(lines, fmt)
    bad = first_errors(records, fmt).orderBy("volume").limit(1).collect()
    if bad:
        raise ParseError(f"{bad[0]['volume']}: {bad[0]['error']}")
    return records


def record_issues(records: DataFrame) -> DataFrame:
    """(volume, rec, level, text): every error and warning of every record, one a row."""
    err = F.transform("errors", lambda e: F.struct(F.lit("error").alias("level"), e.alias("text")))
    warn = F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("level"), w["kind"].alias("text")))
    none = F.expr("cast(array() as array<struct<level: string, text: string>>)")
    return records.select("volume", "rec", F.explode(F.concat(F.coalesce(err, none), F.coalesce(warn, none))).alias("i")).select("volume", "rec", "i.level", "i.text")


def line_places(lines: DataFrame, page: str = "page_number", order: str = "line_no") -> DataFrame:
    """lines with place: their number within the page by y0 rounded half to even to two decimals, x0, and input order."""
    w = Window.partitionBy(page).orderBy(F.bround("y0", 2), "x0", order)
    return lines.withColumn("place", F.row_number().over(w))
