"""Nested records and content documents: flattening, completion, edits and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key


def titled(sections: Column, title: str | Column) -> Column:
    return F.filter(sections, lambda s: s["title"] == title)


def compatible(sections: Column, heading: str) -> Column:
    """Exactly one section of that title, with a text."""
    hit = titled(sections, heading)
    return (F.size(hit) == 1) & F.get(hit, F.lit(0))["text"].isNotNull()


def screened_faces(faces: DataFrame, heading: str, codes: DataFrame | None = None, key: str = "ky_hieu", sections: str = "sections") -> DataFrame:
    """faces with face_key, the normalised code, and dropped: null for faces that go on, else why they don't: ``no_id``, without a code; ``incompatible``, without
    exactly one section of that heading that has a text; ``no_image``, where codes(code) of pictures are given and have none for it."""
    out = faces.withColumn("face_key", normalize_key(F.col(key)))
    fits = F.coalesce(compatible(F.col(sections), heading), F.lit(False))
    why = F.when(F.col("face_key").isNull(), "no_id").when(~fits, "incompatible")
    if codes is None:
        return out.withColumn("dropped", why)
    seen = codes.select(F.col("code").alias("face_key")).distinct().withColumn("__seen", F.lit(True))
    return out.join(seen, "face_key", "left").withColumn("dropped", why.when(F.col("__seen").isNull(), "no_image")).drop("__seen")


def drop_counts(screened: DataFrame, group: str) -> DataFrame:
    """(group, total, kept, no_id, incompatible, no_image) of ``screened_faces``."""
    of = lambda why: F.count_if(F.col("dropped").eqNullSafe(F.lit(why))).alias(why or "kept")
    return screened.groupBy(group).agg(F.count("*").alias("total"), *[of(w) for w in (None, "no_id", "incompatible", "no_image")])


def section_text(sections: Column, title: str) -> Column:
    """The text of the one section of a title; null where there is none or more than one."""
    hit = titled(sections, title)
    return F.when(F.size(hit) == 1, F.get(hit, F.lit(0))["text"])


def content_fields(faces: DataFrame, key: list[str], titles: list[str], metadata: dict[str, str]) -> DataFrame:
    """(key, pos, path, label, value): string metadata first, then sections in the order of titles."""
    meta = [F.struct(F.lit(i).alias("pos"), F.lit(name).alias("path"), F.lit(label).alias("label"), F.coalesce(F.col(name), F.lit("")).alias("value")) for i, (name, label) in enumerate(metadata.items())]
    sec = [F.struct(F.lit(len(metadata) + i).alias("pos"), F.lit(f"sections/{t}").alias("path"), F.lit(t).alias("label"), F.coalesce(section_text(F.col("sections"), t), F.lit("")).alias("value")) for i, t in enumerate(titles)]
    return faces.select(*key, F.explode(F.array(*meta, *sec)).alias("f")).select(*key, "f.*")


def completed(faces: DataFrame, titles: list[str], metadata: list[str]) -> DataFrame:
    """Null metadata as '', and a section with '' for each title that has none."""
    out = faces.withColumns({m: F.coalesce(m, F.lit("")) for m in metadata})
    have = F.transform("sections", lambda s: s["title"])
    gone = F.transform(F.array_except(F.array(*[F.lit(t) for t in titles]), have), lambda t: F.struct(t.alias("title"), F.lit("").alias("text")))
    full = F.transform("sections", lambda s: F.struct(s["title"].alias("title"), F.coalesce(s["text"], F.lit("")).alias("text")))
    return out.withColumn("sections", F.concat(full, gone))


def edited(sections: Column, title: str, text: Column | str) -> Column:
    """Sections with the text of one title replaced; a title that isn't there changes nothing."""
    new = F.lit(text) if isinstance(text, str) else text
    return F.transform(sections, lambda s: F.struct(s["title"].alias("title"), F.when(s["title"] == title, new).otherwise(s["text"]).alias("text")))


def content_map(sections: Column, titles: list[str]) -> Column:
    """Label -> text in the order of titles, '' for what is missing."""
    return F.map_from_arrays(F.array(*[F.lit(t) for t in titles]), F.array(*[F.coalesce(section_text(sections, t), F.lit("")) for t in titles]))


def projected(content: Column, titles: list[str]) -> Column:
    """A content map cut to the given titles; missing and null values are ''."""
    return F.map_from_arrays(F.array(*[F.lit(t) for t in titles]), F.array(*[F.coalesce(F.try_element_at(content, F.lit(t)), F.lit("")) for t in titles]))


def leaf_fields(json: Column) -> Column:
    """Scalar leaves of a JSON object's top level: array<struct<path, value>>, in the order of paths."""
    m = F.from_json(json, "map<string,string>")
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))))


def json_depth(text: Column) -> Column:
    """How deep arrays and objects of a JSON text are nested: its brackets outside strings, counted."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), zero, step, lambda acc: acc["most"])


def tree_leaves(df: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """df without ``text``, a row for each scalar leaf of that JSON at any depth, with its path, like ``$.a[0].b``, and value as text.

    Null is a leaf with a null value; an empty object or list has none; a null text has no leaves; broken JSON and repeated keys are errors. Each level is
    one ``variant_explode``, which passes leaves on, so all is one stage without Python. The levels are counted first, unless ``depth`` gives a bound."""
    df = df.where(F.col(text).isNotNull())
    if depth is None:
        depth = df.agg(F.max(json_depth(F.col(text)))).first()[0] or 0
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.lit("$").alias("path"), F.parse_json(text).alias("__v"))
    for _ in range(depth):
        rows = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("__v").outer()))
        inside = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        leaf = F.col("pos").isNull()
        rows = rows.select(*keep, F.when(leaf, F.col("path")).otherwise(inside).alias("path"), F.when(leaf, F.col("__v")).otherwise(F.col("value")).alias("__v"))
    rows = rows.where(~F.schema_of_variant("__v").isin("OBJECT<>", "ARRAY<VOID>"))
    return rows.select(*keep, "path", F.expr("__v::string").alias("value"))


def history(images: DataFrame, saved: DataFrame, contains: str = "", statuses: tuple[str, ...] = ("Done", "Not Done"), name: str = "image") -> DataFrame:
    """images with Done where a saved document exists, filtered by name and status."""
    out = images.join(saved.select(F.col(name), F.lit(True).alias("__s")).distinct(), name, "left")
    out = out.withColumn("status", F.when(F.col("__s"), "Done").otherwise("Not Done")).drop("__s")
    return out.where(F.contains(F.lower(name), F.lit(contains.lower())) & F.col("status").isin(*statuses))


def exclusive(normal: DataFrame, mismatch: DataFrame, seq: str = "seq", name: str = "image") -> DataFrame:
    """One document of each image, whichever kind was saved last."""
    both = normal.withColumn("kind", F.lit("normal")).unionByName(mismatch.withColumn("kind", F.lit("mismatch")), allowMissingColumns=True)
    return both.groupBy(name).agg(F.max_by("kind", F.struct(seq, "kind")).alias("kind"), F.max(seq).alias(seq))


def both_saved(normal: DataFrame, mismatch: DataFrame, name: str = "image") -> DataFrame:
    return normal.select(name).intersect(mismatch.select(name))
