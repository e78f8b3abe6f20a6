"""Corpus analytics: term and pair frequencies, years and decades, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decade, has_summary, nfc, pairs, percent, segments, years

RARE = 20


def tokenised(docs: DataFrame, group: str, doc: str, text: str) -> DataFrame:
    """(volume, doc, segs, trimmed) of each text."""
    return docs.select(F.col(group).alias("volume"), F.col(doc).alias("doc"), segments(F.col(text)).alias("segs"), has_summary(F.col(text)).alias("trimmed"))


def document_terms(docs: DataFrame, kind: str = "single", group: str = "lang", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(volume, doc, term, n): counted within each document first, where the rows of a document are: whole texts cross the network, which
    are smaller than their terms. A null term with n = 0 stands for each document that has a word."""
    rows = docs.select(F.col(group).alias("volume"), F.col(doc).alias("doc"), nfc(F.col(text)).alias("text")).repartition("volume", "doc")  # Python loses how rows are dealt
    segs = rows.select("volume", "doc", segments(F.col("text"), True).alias("segs"))
    terms = F.flatten("segs") if kind == "single" else F.flatten(F.transform("segs", pairs))
    every = F.when(F.size("segs") > 0, F.concat(terms, F.array(F.lit(None).cast("string"))))  # explode drops a null array
    return segs.select("volume", "doc", F.explode(every).alias("term")).groupBy("volume", "doc", "term").agg(F.count("term").alias("n"))


def frequency(docs: DataFrame, kind: str = "single", group: str = "lang", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(volume, term, count, frequency_pct, inscription_count, inscription_pct). Texts are tokenised once: totals and terms
    read the same exchange, for which both need all of its columns."""
    terms = document_terms(docs, kind, group, doc, text).groupBy("volume", "term").agg(F.sum("n").alias("count"), F.count("*").alias("inscription_count"))
    totals = terms.groupBy("volume").agg(F.sum("count").alias("total"), F.max(F.when(F.col("term").isNull(), F.col("inscription_count"))).alias("valid"))
    # count > 0 leaves the null terms out; a condition on term would be pushed below the exchange
    out = terms.where("count > 0").join(totals, "volume")
    return out.select("volume", "term", "count", percent(F.col("count"), F.col("total")).alias("frequency_pct"), "inscription_count", percent(F.col("inscription_count"), F.col("valid")).alias("inscription_pct"))


def top_terms(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms of each volume, ties in term order; 0 keeps all."""
    if n == 0:
        return freq
    w = Window.partitionBy("volume").orderBy(F.desc("count"), "term")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rare_terms(freq: DataFrame, below: int = RARE) -> DataFrame:
    return freq.groupBy("volume").agg(F.count_if(F.col("count") < below).alias("rare_types"), F.count("*").alias("types"))


def volume_summary(docs: DataFrame, group: str = "lang", doc: str = "doc_id", text: str = "text") -> DataFrame:
    t = tokenised(docs, group, doc, text).select("volume", "trimmed", F.size(F.flatten("segs")).cast("long").alias("n"), F.aggregate("segs", F.lit(0).cast("long"), lambda a, s: a + F.size(s) - 1).alias("p"))
    return t.groupBy("volume").agg(
        F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("valid"), F.count_if(F.col("n") == 0).alias("missing"),
        F.count_if("trimmed").alias("contaminated"), F.sum("n").alias("total_single"), F.sum("p").alias("total_pairs"),
    )


def with_years(df: DataFrame, text: str, policy: str = "earliest") -> DataFrame:
    """df with years, status (ok, multiple_years, missing_year) and the counted year of the policy
    (earliest, latest or exclude); a single year is always counted."""
    y = df.withColumn("years", F.coalesce(years(F.col(text)), F.expr("cast(array() as array<int>)")))
    n = F.size("years")
    status = F.when(n == 0, "missing_year").when(n == 1, "ok").otherwise("multiple_years")
    pick: Column = {"earliest": F.array_min("years"), "latest": F.array_max("years"), "exclude": F.when(n == 1, F.array_min("years"))}[policy]
    return y.withColumns({"status": status, "year": pick})


def year_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count("year").alias("counted"), F.count_if(F.col("year").isNull()).alias("excluded"),
        F.count_if(F.col("status") == "missing_year").alias("missing"), F.count_if(F.col("status") == "multiple_years").alias("multiple"),
    )


def decades(df: DataFrame, year: str = "year") -> DataFrame:
    """(decade_start, decade_end, count) from the first to the last decade, empty ones included."""
    counts = df.where(F.col(year).isNotNull()).groupBy(decade(F.col(year)).alias("decade_start")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("decade_start").alias("lo"), F.max("decade_start").alias("hi")).where("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi", F.lit(10))).alias("decade_start"))
    return every.join(counts, "decade_start", "left").select("decade_start", (F.col("decade_start") + 9).alias("decade_end"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def review(df: DataFrame) -> DataFrame:
    return df.where("status <> 'ok'")


def status_totals(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def extraction_summary(records: DataFrame, issues: DataFrame, number: str = "number") -> DataFrame:
    """(valid, invalid, unassigned): records, distinct numbers with errors, issues without a number. A number
    is counted once, whether it has warnings or not."""
    rows = records.select(F.lit("r").alias("kind"), F.col(number).alias("number"))
    rows = rows.unionByName(issues.where(F.size("errors") > 0).select(F.lit("i").alias("kind"), F.col(number).alias("number")))
    bad = F.col("kind") == "i"
    return rows.agg(F.count_if(F.col("kind") == "r").alias("valid"), F.count_distinct(F.when(bad, F.col("number"))).alias("invalid"), F.count_if(bad & F.col("number").isNull()).alias("unassigned"))


def extraction_report(records: DataFrame, issues: DataFrame, missing: str, volume: str = "volume", number: str = "number") -> DataFrame:
    """(volume, total, valid, invalid, invalid_numbers, missing_numbers, unassigned) of each volume of records(volume, …) and issues(volume, number, errors): distinct
    numbers with errors, in order, those with an error that holds ``missing``, and errors without a number. Volumes without either are left out."""
    bad = issues.where(F.size("errors") > 0).select(volume, F.col(number).alias("n"), F.exists("errors", lambda e: F.contains(e, F.lit(missing))).alias("lacks"))
    rows = records.select(volume, F.lit(None).cast(issues.schema[number].dataType).alias("n"), F.lit(None).cast("boolean").alias("lacks")).unionByName(bad)
    record = F.col("lacks").isNull()
    out = rows.groupBy(volume).agg(
        F.count_if(record).alias("valid"), F.array_sort(F.collect_set(F.when(~record, F.col("n")))).alias("invalid_numbers"),
        F.array_sort(F.collect_set(F.when(F.col("lacks"), F.col("n")))).alias("missing_numbers"), F.count_if(~record & F.col("n").isNull()).alias("unassigned"),
    )
    invalid = F.size("invalid_numbers").cast("long")
    return out.select(volume, (F.col("valid") + invalid).alias("total"), "valid", invalid.alias("invalid"), "invalid_numbers", "missing_numbers", "unassigned")
