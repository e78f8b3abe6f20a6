"""Queries over texts: terms, years, winners, keys, lines and strings. Each has the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import records as N
from ..operators import relational as R
from ..operators import segment as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SEGS = """
segs AS (
  SELECT lang AS volume, doc_id AS doc, s.seg AS seg, s.i AS i FROM documents,
  LATERAL (SELECT unnest(p) AS seg, generate_subscripts(p, 1) AS i FROM (SELECT regexp_split_to_array(
    regexp_replace(lower(replace(replace(nfc_normalize(text), 'Ð', 'Đ'), 'ð', 'đ')), '(?ms)^\\s*toát\\s+yếu\\b.*', ''), '[^\\p{Latin}\\s]+') AS p)) s),
words AS (
  SELECT volume, doc, i, list_filter(regexp_split_to_array(seg, '\\s+'), lambda w: w <> '') AS w FROM segs),
single AS (SELECT volume, doc, unnest(w) AS term FROM words),
paired AS (SELECT volume, doc, unnest(list_transform(range(1, greatest(len(w), 1)::BIGINT), lambda k: w[k] || ' ' || w[k + 1])) AS term FROM words)
"""


def freq_sql(source: str) -> str:
    return f"""WITH {SEGS},
valid AS (SELECT volume, count(DISTINCT doc) AS valid FROM single GROUP BY 1),
t AS (SELECT volume, term, count(*) AS count, count(DISTINCT doc) AS inscription_count FROM {source} GROUP BY 1, 2),
f AS (SELECT t.*, sum(count) OVER (PARTITION BY volume) AS total FROM t)
SELECT f.volume, term, count, round(100.0 * count / total, 6) AS frequency_pct, inscription_count, round(100.0 * inscription_count / valid, 6) AS inscription_pct FROM f JOIN valid USING (volume)"""


@query(freq_sql("single"))
def term_frequency(spark, sf):
    return A.frequency(load(spark, sf, "documents"))


@query(freq_sql("paired"))
def pair_frequency(spark, sf):
    return A.frequency(load(spark, sf, "documents"), "pairs")


@query(f"SELECT volume, count_if(count < 20) AS rare_types, count(*) AS types FROM ({freq_sql('single')}) GROUP BY 1")
def rare_terms(spark, sf):
    return A.rare_terms(A.frequency(load(spark, sf, "documents")))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY count DESC, term) AS rank FROM ({freq_sql('single')})) WHERE rank <= 10")
def topk_terms_per_group(spark, sf):
    return A.top_terms(A.frequency(load(spark, sf, "documents")), 10)


@query(f"""WITH {SEGS},
d AS (SELECT volume, doc, sum(len(w)) AS n, sum(greatest(len(w) - 1, 0)) AS p FROM words GROUP BY 1, 2)
SELECT volume, count(*) AS total, count_if(n > 0) AS valid, count_if(n = 0) AS missing,
  (SELECT count(*) FROM documents WHERE lang = volume AND regexp_matches(lower(text), '(?m)^\\s*toát\\s+yếu\\b')) AS contaminated,
  sum(n)::BIGINT AS total_single, sum(p)::BIGINT AS total_pairs FROM d GROUP BY 1""")
def volume_summary(spark, sf):
    return A.volume_summary(load(spark, sf, "documents"))


YEARS = """SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'),
  lambda w: regexp_full_match(w, '[12][0-9]{3}')), lambda w: w::INT))) AS y FROM documents"""


@query(f"SELECT doc_id, array_to_string(y, ',') AS years FROM ({YEARS})")
def year_extract(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(T.years(F.col("text")), lambda y: y.cast("string")), ",").alias("years"))


def _policy(policy: str, sql: str):
    @query(f"SELECT doc_id, CASE WHEN len(y) = 0 THEN 'missing_year' WHEN len(y) = 1 THEN 'ok' ELSE 'multiple_years' END AS status, {sql} AS year FROM ({YEARS})")
    def f(spark, sf):
        return A.with_years(load(spark, sf, "documents"), "text", policy).select("doc_id", "status", "year")

    name = f"year_policy_{policy}"
    QUERIES[name], SQL[name] = QUERIES.pop("f"), SQL.pop("f")


_policy("earliest", "list_min(y)")
_policy("latest", "list_max(y)")
_policy("exclude", "CASE WHEN len(y) = 1 THEN list_min(y) END")


@query(f"SELECT count(*) AS total, count_if(len(y) > 0) AS counted, count_if(len(y) = 0) AS excluded, count_if(len(y) = 0) AS missing, count_if(len(y) > 1) AS multiple FROM ({YEARS})")
def year_summary(spark, sf):
    return A.year_summary(A.with_years(load(spark, sf, "documents"), "text"))


@query("""WITH y AS (SELECT (1600 + (c_custkey % 7) * 35 - (c_custkey % 3) * 4)::INT AS year FROM customer),
c AS (SELECT (floor(year / 10.0) * 10)::INT AS decade_start, count(*) AS n FROM y GROUP BY 1),
e AS (SELECT unnest(range((SELECT min(decade_start) FROM c), (SELECT max(decade_start) FROM c) + 10, 10))::INT AS decade_start)
SELECT decade_start, decade_start + 9 AS decade_end, coalesce(n, 0) AS count FROM e LEFT JOIN c USING (decade_start)""")
def decade_histogram(spark, sf):
    c = load(spark, sf, "customer").select((1600 + (F.col("c_custkey") % 7) * 35 - (F.col("c_custkey") % 3) * 4).cast("int").alias("year"))
    return A.decades(c)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_totals(spark, sf):
    return A.status_totals(load(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


# ---------------------------------------------------------------- winners and keys


def _faces(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("volume"), (F.col("o_custkey") % 500).cast("string").alias("face_key"), F.col("o_orderpriority").substr(1, 1).cast("int").alias("priority"),
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 97).alias("record_id"), (F.col("o_orderkey") % 97 + 1).alias("number"),
    )


FACES = "faces AS (SELECT o_orderstatus AS volume, (o_custkey % 500)::VARCHAR AS face_key, substr(o_orderpriority, 1, 1)::INT AS priority, o_orderkey AS seq, o_orderkey % 97 AS record_id, o_orderkey % 97 + 1 AS number FROM orders)"
WON = f"{FACES}, won AS (SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY volume, face_key) AS first_seq, row_number() OVER (PARTITION BY volume, face_key ORDER BY priority DESC, seq DESC) AS rn FROM faces) WHERE rn = 1)"


@query(f"WITH {WON} SELECT volume, face_key, priority, seq, record_id, number, first_seq FROM won")
def winner_merge(spark, sf):
    return R.merge_faces(_faces(spark, sf)).select("volume", "face_key", "priority", "seq", "record_id", "number", "first_seq")


@query(f"""WITH {WON}, r AS (SELECT volume, record_id, number, array_to_string(list(face_key ORDER BY first_seq), ',') AS faces, min(first_seq) AS first_seq FROM won GROUP BY 1, 2, 3)
SELECT volume, record_id, number, faces, row_number() OVER (PARTITION BY volume ORDER BY number IS NULL, number, first_seq) AS position FROM r""")
def winner_regroup(spark, sf):
    return R.regroup(R.merge_faces(_faces(spark, sf))).withColumn("faces", F.array_join("faces", ","))


SCREENED = """f AS (SELECT o_orderkey, o_orderstatus AS volume, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN '00' || o_custkey % 500 ELSE (o_custkey % 500)::VARCHAR END AS code, substr(o_orderpriority, 1, 1)::INT AS p FROM orders),
c AS (SELECT DISTINCT (c_custkey * 3 % 500)::VARCHAR AS code FROM customer), k AS (SELECT *, CASE WHEN trim(code) <> '' THEN (trim(code)::INT)::VARCHAR END AS face_key FROM f),
s AS (SELECT o_orderkey, volume, face_key, CASE WHEN face_key IS NULL THEN 'no_id' WHEN p IN (2, 3, 4) THEN 'incompatible' WHEN face_key NOT IN (SELECT code FROM c) THEN 'no_image' END AS dropped FROM k)"""


def _screened(spark, sf) -> DataFrame:
    """By priority a face has its section, two of it, one without a text, none, or one among others."""
    k = F.col("o_orderkey")
    number = (F.col("o_custkey") % 500).cast("string")
    code = F.when(k % 11 == 0, " ").when(k % 2 == 0, F.concat(F.lit("00"), number)).otherwise(number)
    part = lambda title, text: F.struct(F.lit(title).alias("title"), F.lit(text).cast("string").alias("text"))
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    sections = F.when(p == 1, F.array(part("Text", "x"))).when(p == 2, F.array(part("Text", "x"), part("Text", "y"))).when(p == 3, F.array(part("Text", None))).when(p == 4, F.array(part("Note", "x"))).otherwise(F.array(part("Note", "x"), part("Text", "")))
    faces = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("volume"), code.alias("ky_hieu"), sections.alias("sections"))
    codes = load(spark, sf, "customer").select((F.col("c_custkey") * 3 % 500).cast("string").alias("code"))
    return N.screened_faces(faces, "Text", codes)


@query(f"WITH {SCREENED} SELECT o_orderkey, volume, face_key, dropped FROM s")
def screened_faces(spark, sf):
    return _screened(spark, sf).select("o_orderkey", "volume", "face_key", "dropped")


@query(f"WITH {SCREENED} SELECT volume, count(*) AS total, count_if(dropped IS NULL) AS kept, count_if(dropped = 'no_id') AS no_id, count_if(dropped = 'incompatible') AS incompatible, count_if(dropped = 'no_image') AS no_image FROM s GROUP BY 1")
def merge_drop_counts(spark, sf):
    return N.drop_counts(_screened(spark, sf), "volume")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf):
    return R.winners(load(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, first_seq FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first_seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def registry_upsert(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id")
    return R.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), "user_id", "event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 7 = 0 THEN NULL ELSE coalesce(nullif(ltrim(lpad(c_custkey::VARCHAR, 6, '0'), '0'), ''), '0') END AS key FROM customer""")
def key_normalize(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.col("c_name"), F.lit(" "))).when(k % 7 == 0, F.lit("  ")).otherwise(F.lpad(k.cast("string"), 6, "0"))
    return load(spark, sf, "customer").select("c_custkey", T.normalize_key(raw).alias("key"))


CODES = "img AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0' || c_custkey ELSE c_custkey::VARCHAR END AS image_code FROM customer), fk AS (SELECT CASE WHEN o_custkey % 6 = 0 THEN '0' || o_custkey ELSE o_custkey::VARCHAR END AS face_key, count(*) AS n FROM orders GROUP BY 1)"


def _codes(spark, sf):
    c, o = F.col("c_custkey"), F.col("o_custkey")
    images = load(spark, sf, "customer").select("c_custkey", F.when(c % 3 == 0, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string")).alias("image_code"))
    faces = load(spark, sf, "orders").select(F.when(o % 6 == 0, F.concat(F.lit("0"), o.cast("string"))).otherwise(o.cast("string")).alias("face_key"))
    return images, faces


@query(f"WITH {CODES} SELECT c_custkey, image_code, coalesce(a.face_key, b.face_key) AS matched, coalesce(a.n, b.n, 0) AS match_count FROM img LEFT JOIN fk a ON a.face_key = image_code LEFT JOIN fk b ON b.face_key = ltrim(image_code, '0')")
def lookup_exact_then_stripped(spark, sf):
    return R.lookup(*_codes(spark, sf))


@query(f"WITH {CODES}, r AS (SELECT coalesce(nullif(ltrim(face_key, '0'), ''), '0') AS key, sum(n) AS n FROM fk GROUP BY 1) SELECT i.key, coalesce(n, 0)::BIGINT AS n_matches FROM (SELECT DISTINCT coalesce(nullif(ltrim(image_code, '0'), ''), '0') AS key FROM img) i LEFT JOIN r USING (key)")
def qa_match_counts(spark, sf):
    return R.match_counts(*_codes(spark, sf), "image_code", "face_key")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return R.duplicates(load(spark, sf, "orders").select("o_custkey"), ["o_custkey"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_images(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_issues(spark, sf):
    issues = load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, F.array(F.lit("bad"))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"))
    return R.without_errors(load(spark, sf, "documents").select("doc_id", "lang"), issues, "doc_id")


@query("""WITH d AS (SELECT DISTINCT nullif(c_nationkey % 13, 5) AS k FROM customer), f AS (SELECT DISTINCT nullif(s_nationkey % 17, 5) AS k FROM supplier)
SELECT coalesce(d.k, f.k) AS k, d.m IS NOT NULL AS declared, f.m IS NOT NULL AS found FROM (SELECT *, 1 AS m FROM d) d FULL JOIN (SELECT *, 1 AS m FROM f) f ON d.k IS NOT DISTINCT FROM f.k""")
def declared_or_found(spark, sf):
    d = load(spark, sf, "customer").select(F.nullif(F.col("c_nationkey") % 13, F.lit(5)).alias("k"))
    f = load(spark, sf, "supplier").select(F.nullif(F.col("s_nationkey") % 17, F.lit(5)).alias("k"))
    return R.declared_or_found(d, f, ["k"])


# ---------------------------------------------------------------- lines

LINES = "lines AS (SELECT doc_id AS volume, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _lines(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("volume"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


IS_TITLE = "regexp_matches(text, '^[A-Z][a-z]* (the|of|de|la|die|der) ')"
TITLE_RE = "^[A-Z][a-z]* (the|of|de|la|die|der) "


@query(f"WITH {LINES} SELECT volume, line_no, text FROM lines")
def line_explode(spark, sf):
    return _lines(spark, sf)


RECS = f"recs AS (SELECT * FROM (SELECT *, {IS_TITLE} AS is_title, sum({IS_TITLE}::INT) OVER (PARTITION BY volume ORDER BY line_no)::BIGINT AS rec FROM lines) WHERE rec > 0)"


@query(f"WITH {LINES}, {RECS} SELECT volume, rec, count(*) AS n_lines, min(line_no) AS first_no, sum(length(text))::BIGINT AS chars FROM recs GROUP BY 1, 2")
def record_segments(spark, sf):
    r = S.number_records(_lines(spark, sf), TITLE_RE)
    return r.groupBy("volume", "rec").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_no"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM (SELECT DISTINCT conv_id, turn, role FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2))""")
def carry_forward(spark, sf):
    c = load(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return c.select("conv_id", "turn", S.carry(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn").alias("last_user"))


@query(f"WITH {LINES}, {RECS} SELECT volume, rec, min(line_no) AS first_no, md5(regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g')) AS body FROM recs GROUP BY 1, 2")
def section_text(spark, sf):
    r = S.section_texts(S.number_records(_lines(spark, sf), TITLE_RE), ["volume", "rec"])
    return r.select("volume", "rec", "first_no", F.md5(F.col("body").cast("binary")).alias("body"))


@query("""WITH t AS (SELECT o_custkey AS volume, o_orderkey AS line_no, (o_orderkey % 4 + 1)::INT AS number FROM orders),
d AS (SELECT *, number - row_number() OVER (PARTITION BY volume ORDER BY line_no) AS d FROM t)
SELECT volume, count(*) AS n, arg_min(number, line_no) AS first, count(DISTINCT number) < count(*) AS repeated, count(DISTINCT d) = 1 AS consecutive FROM d GROUP BY 1""")
def consecutive_check(spark, sf):
    t = load(spark, sf, "orders").select(F.col("o_custkey").alias("volume"), F.col("o_orderkey").alias("line_no"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("number"))
    return S.consecutive(t)


@query(f"""WITH {LINES}, f AS (SELECT *, max((regexp_matches(text, 'Licensed|License') AND line_no % 12 <= 8)::INT) OVER (PARTITION BY volume ORDER BY line_no) AS f FROM lines)
SELECT volume, count(*) AS n, max(line_no) AS last_no FROM f WHERE f = 0 GROUP BY 1""")
def footnote_cut(spark, sf):
    l = _lines(spark, sf).withColumn("font_size", (F.col("line_no") % 12).cast("double"))  # noqa: E741
    return S.cut_footnotes(l, "Licensed|License", 8.0, ["volume"], [F.col("line_no")]).groupBy("volume").agg(F.count("*").alias("n"), F.max("line_no").alias("last_no"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_partkey % 800 < 40 OR l_partkey % 800 + 12 > 800 - 45)")
def margin_filter(spark, sf):
    y = (F.col("l_partkey") % 800).cast("double")
    return S.inside_margins(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", y.alias("y0"), (y + 12).alias("y1")), F.lit(800.0), 40, 45).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- strings


@query("SELECT doc_id, length_grapheme(text)::BIGINT AS n FROM documents")
def grapheme_count(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(T.graphemes(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(replace(regexp_replace(nfc_normalize(text), '[()\\s]', '', 'g'), '@', chr(1)), '[\\p{Pc}\\p{Pd}\\p{Po}]', '', 'g')) AS h FROM documents")
def normalize_annotation(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(F.translate(T.annotation_text(F.col("text")), "@", "\u0001").cast("binary")).alias("h"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[\\x{FFFD}\\p{Cc}]', '', 'g'), ' +', ' ', 'g')) AS line FROM benchmark")
def clean_line(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", T.clean_line(F.col("text")).alias("line"))


@query("SELECT item_id, trim(regexp_replace(replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ss'), '\\s+', ' ', 'g')) AS key FROM benchmark")
def label_key(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", T.label_key(F.col("text")).alias("key"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '[0-9]+[A-Za-z]?'), ',') AS ids FROM pages")
def identifiers(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.array_join(T.identifiers(F.col("url")), ",").alias("ids"))


@query("SELECT item_id, regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS t FROM benchmark")
def layout_space(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", T.layout(F.col("text"), "space").alias("t"))


@query("SELECT item_id, regexp_replace(text, '\\s*\\n\\s*', '', 'g') AS t FROM benchmark")
def layout_nospace(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", T.layout(F.col("text"), "none").alias("t"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def doc_fingerprint(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("h"))


@query("SELECT event_id, json_keys(props)[1] AS path, props->>('$.' || json_keys(props)[1]) AS value FROM events WHERE len(json_keys(props)) > 0")
def leaf_fields(spark, sf):
    from ..operators.records import leaf_fields as leaves

    return load(spark, sf, "events").select("event_id", F.explode(leaves(F.col("props"))).alias("l")).select("event_id", "l.path", "l.value")


@query("""WITH c AS (SELECT c_custkey % 10 AS font, c_custkey AS k FROM customer)
SELECT DISTINCT font, code::INT AS code FROM (SELECT font, k // 65536 AS code FROM c UNION ALL SELECT font, k % 65536 FROM c)""")
def used_codes(spark, sf):
    from ..sources.readers import used_codes as codes

    c = load(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("font"), F.concat(F.lit("<"), F.lpad(F.hex("c_custkey"), 8, "0"), F.lit("> Tj")).alias("content"))
    return codes(c)
