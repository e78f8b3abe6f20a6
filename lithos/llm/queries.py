"""Registered queries of this subpackage and their SQL; each query is a thin wrapper of an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import leaks
from .divergence import divergence
from .jaccard import jaccard_components
from .langid import identify, train_langid
from .linededup import line_dedup
from .manifest import fold as fold_proof
from .manifest import framed, manifest, proof_text
from .packing import pack
from .quality import quality
from .secrets import secrets
from .sharding import shard
from .topk import top_k
from .toxicity import score_toxicity, train_toxicity
from .urls import UrlRule, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, part: int) -> Column:
    """Whether crc32 of the doc_id's text falls in that fold; a null doc_id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_langid(docs.where(~fold(4, 2)))
    got = identify(docs, model)
    return got.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


#: The listed rules.
URL_RULES = [UrlRule("block", "com/en/"), UrlRule("allow", "example.com/en/7"), UrlRule("allow", "net/de/"), UrlRule("block", "example.net/de/8"), UrlRule("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~fold(5, 0)))
    got = score_toxicity(docs, model)
    return got.select(
        "doc_id",
        fold(5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.length("text").cast("long").alias("n_chars"),
        F.crc32("text").alias("text_crc32"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, t=0.9)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold(5, 0), F.sha2(framed("doc_id", "source", "lang", "n_chars", lowered), 256))
    got = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], carry={"tampered": tampered})
    got = got.withColumn("folded_root", fold_proof(F.coalesce("tampered", "leaf"), F.col("proof")))
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_top_k": op13_exact_top_k,
}

_W = "[^\\x20\\x09-\\x0D]"



def _merkle_levels(t: str, base: str, levels: int) -> str:
    """CTEs t0 .. t<levels> of nodes (g, i, w, h) above ``base``, w being the nodes of the level, and t<l>r of its runs; a level of one node is kept as it is."""
    out = f"{t}0 AS (SELECT * FROM {base})"
    for n in range(levels):
        out += f""",
{t}{n}r AS (SELECT g, i // 16 AS i, any_value(w) AS w, array_agg(h ORDER BY i) AS k FROM {t}{n} GROUP BY 1, 2),
{t}{n + 1} AS (SELECT g, i, CASE WHEN w = 1 THEN 1 ELSE (w + 15) // 16 END AS w, CASE WHEN w = 1 THEN k[1] ELSE sha256(array_to_string(k, '')) END AS h FROM {t}{n}r)"""
    return out


def _merkle_folds(t: str, rows: str, levels: int) -> str:
    """CTEs that take ``rows`` (g, i, f, s, ...) up: f is folded with the siblings, s gets them appended."""
    out = []
    for n in range(levels):
        pos = f"(r.i // {16**n}) % 16"
        left, right = f"array_to_string(k[1:{pos}], '')", f"array_to_string(k[{pos} + 2:], '')"
        cond = "CASE WHEN w = 1 THEN"
        out.append(f"{t}{n}f AS (SELECT r.* EXCLUDE (f, s), {cond} f ELSE sha256({left} || f || {right}) END AS f, {cond} s ELSE s || {left} || {right} END AS s FROM {rows} r JOIN {t}{n}r p ON p.g IS NOT DISTINCT FROM r.g AND p.i = r.i // {16 ** (n + 1)})")
        rows = f"{t}{n}f"
    return ",\n".join(out)


def _framed(*columns: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in columns)


#: SQL of the queries that SQL can express. The other operators learn, search or place greedily; tests/llm
#: holds their brute-force versions.
SQL: dict[str, str] = {
    "op1_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
s AS (SELECT d.doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND NOT n_symbols > 0.1 * word_chars AND NOT 2 * n_dup_lines > len(string_split(t, chr(10))) AND NOT word_chars < 2 * n_words AND NOT word_chars > 14 * n_words
  AND NOT 2 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) > n_words AND NOT 2 * len(list_filter(w, lambda x: suffix(x, '!!'))) > n_words
  AND NOT 10 * len(list_distinct(w)) < n_words AND NOT 2 * len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) > n_words AS kept FROM b""",
    "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, chr(1)) ELSE w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, r.c FROM r JOIN both_ ON x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op11_source_divergence": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS a FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(a) AS na FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS s FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000 * (coalesce(n, 0) + 1)::HUGEINT) // (s + v))::BIGINT AS p, (1 + (1000000000 * (a + 1)::HUGEINT) // (na + v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 200""",
    # six levels: up to 16^6 rows of a source and as many sources
    "op12_merkle_manifest": f"""
WITH d AS (SELECT doc_id, source AS g, sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
  sha256({_framed("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS crc FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS w FROM d),
{_merkle_levels("a", "(SELECT g, i, w, leaf AS h FROM r)", 6)},
o AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM a6),
{_merkle_levels("b", "(SELECT 0 AS g, i, w, h FROM o)", 6)},
s AS (SELECT doc_id, g, i, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS f, '' AS s FROM r),
{_merkle_folds("a", "s", 6)},
t AS (SELECT doc_id, leaf, 0 AS g, o.i, o.h AS subroot, f, s FROM a5f JOIN o ON o.source IS NOT DISTINCT FROM a5f.g),
{_merkle_folds("b", "t", 6)}
SELECT doc_id, leaf, subroot, b6.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = b6.h AS verified FROM b5f, b6""",
    "op13_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5""",
}
