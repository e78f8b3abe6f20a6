"""Glyph tables: decoding by profile, and matching unknown glyphs to reference glyphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import font_key

#: Fixed value: what stands for a character that can't be decoded.
UNRESOLVED = "□"
#: Reference rows and asking rows of one block of the nearest-neighbour search; a pair of blocks is what a task holds.
BLOCK, ASKED = 4096, 65536


def signature(commands: Column) -> Column:
    return F.substring(F.sha2(commands.cast("binary"), 256), 1, 24)


def lowest_code(cmap: DataFrame) -> DataFrame:
    """One code point per glyph, the lowest."""
    return cmap.groupBy("glyph").agg(F.min("codepoint").alias("codepoint"))


def decode(glyphs: DataFrame, profile: DataFrame, key: str = "signature") -> DataFrame:
    """glyphs(…, key, fallback) with char and status: matched, fallback (the source's own character) or
    unresolved."""
    out = glyphs.join(profile.select(key, F.col("char").alias("__c")).dropDuplicates([key]), key, "left")
    clean = F.regexp_replace("fallback", "[\\x{FFFD}\\p{Cc}\\p{Cs}]", "")
    char = F.coalesce("__c", F.when(clean != "", clean), F.lit(UNRESOLVED))
    status = F.when(F.col("__c").isNotNull(), "matched").when(clean != "", "fallback").otherwise("unresolved")
    return out.withColumn("char", char).withColumn("status", status).drop("__c")


def decode_statistics(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "fallback", "unresolved")])


def miss_counts(decoded: DataFrame, keys: list[str], xref: str = "xref") -> DataFrame:
    """Undecoded glyphs by evidence; a null xref orders first."""
    return decoded.where("status <> 'matched'").groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.coalesce(F.col(xref), F.lit(-1)), *[k for k in keys if k != xref])


def match_glyphs(glyphs: DataFrame, references: DataFrame, group: str = "font", vec: str = "pixels") -> DataFrame:
    """glyphs(id, group, signature, vec) against references(group, signature, codepoint, vec): the lowest code
    point of equal signatures; a blank glyph is a space; of the rest the reference with the least L1
    distance, the lowest code point of equal ones. method says which.

    Only glyphs without an exact match are compared. Both sides are dealt in blocks within their group;
    each (glyph, reference block) gives one candidate, so the search keeps one row per block, not per pair.
    """
    exact = references.groupBy(group, "signature").agg(F.min("codepoint").alias("codepoint"))
    hit = glyphs.join(exact, [group, "signature"]).select("id", "codepoint", F.lit("exact").alias("method"), F.lit(0.0).alias("distance"))
    rest = glyphs.join(exact, [group, "signature"], "left_anti")
    blank = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")) == 0
    space = rest.where(blank).select("id", F.lit(32).cast("int").alias("codepoint"), F.lit("blank").alias("method"), F.lit(0.0).alias("distance"))
    rest = rest.where(~blank).select("id", F.col(group).alias("grp"), F.col(vec).cast("array<double>").alias("v"))
    sizes = references.groupBy(group).agg(F.count("*").alias("n")).select(F.col(group).alias("grp"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(rest.groupBy("grp").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("lots")), "grp")
    refs = references.select(F.col(group).alias("grp"), F.col("codepoint").cast("int").alias("codepoint"), F.col(vec).cast("array<double>").alias("v")).join(sizes, "grp")
    refs = refs.withColumn("blk", F.pmod(F.xxhash64("codepoint", "v"), "blocks").cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("grp", "blk", "lot", "codepoint", "v")
    ask = rest.join(sizes, "grp").withColumn("lot", F.pmod(F.xxhash64("id"), "lots").cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "blk", "lot", "id", "v")

    def rows(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def nearest(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("codepoint", pa.int32()), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        code = right.column("codepoint").to_numpy()
        order = np.argsort(code, kind="stable")
        r, code = rows(right)[order], code[order]
        best, dist = np.zeros(left.num_rows, int), np.zeros(left.num_rows)
        for i, x in enumerate(rows(left)):
            d = np.abs(r - x).sum(1)
            best[i] = d.argmin()  # the first of equal ones has the lowest code point
            dist[i] = d[best[i]]
        return pa.table([left.column("id").cast(pa.int64()), pa.array(code[best], pa.int32()), pa.array(dist)], schema=schema)

    near = ask.groupBy("grp", "blk", "lot").cogroup(refs.groupBy("grp", "blk", "lot")).applyInArrow(nearest, "id long, codepoint int, distance double")
    near = near.groupBy("id").agg(F.min(F.struct("distance", "codepoint")).alias("m")).select("id", "m.codepoint", F.lit("nearest").alias("method"), "m.distance")
    return hit.unionByName(space).unionByName(near)


def profile_problems(profile: DataFrame) -> DataFrame:
    """Rows whose character, code point and U+ name disagree."""
    name = F.concat(F.lit("U+"), F.lpad(F.hex(F.col("codepoint")), 4, "0"))
    code = F.conv(F.hex(F.encode("char", "UTF-32")), 16, 10).cast("long")
    return profile.where((F.length("char") != 1) | (code != F.col("codepoint")) | ((F.col("codepoint") < 65536) & (F.col("unicode") != name)))


def embedded_fonts(fonts: DataFrame) -> DataFrame:
    """Usable two-byte fonts, one per normalised name, in the order of their names."""
    ok = (F.col("xref") > 0) & (F.col("type") == "Type0") & F.lower("ext").isin("cff", "cid", "ttf", "otf") & F.col("encoding").isin("Identity-H", "Identity-V")
    first = F.row_number().over(Window.partitionBy("key").orderBy("xref"))
    return fonts.where(ok).withColumn("key", font_key(F.col("name"))).withColumn("__r", first).where("__r = 1").drop("__r").orderBy(F.lower("name"))


def best_reference(fonts: DataFrame, references: DataFrame) -> DataFrame:
    """The reference file of each font key: least style priority, then least file name."""
    return fonts.join(references, "key").groupBy("key").agg(F.min(F.struct("style_priority", "file")).alias("m")).select("key", "m.file")


def encoded_font(name: Column, tokens: list[str], exact: bool = False) -> Column:
    """Whether a font is one of those to decode: its name holds a token, or (exact) equals one but for
    subset tag, case and signs."""
    if exact:
        return font_key(name).isin(*[font_key(F.lit(t)) for t in tokens]) if tokens else F.lit(False)
    return F.exists(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.contains(name, t))


def profile_json(profile: DataFrame) -> DataFrame:
    """One JSON member a row, (signature, member), in the order of signatures: a sorted profile file by lines."""
    body = F.to_json(F.struct("glyph", "codepoint", "unicode", "char"))
    return profile.select("signature", F.concat(F.to_json(F.array("signature")).substr(F.lit(2), F.length(F.to_json(F.array("signature"))) - 2), F.lit(": "), body).alias("member")).orderBy("signature")
