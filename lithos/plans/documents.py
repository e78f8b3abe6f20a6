"""Queries over saved documents, payloads, parse errors, fonts and displayed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import analytics as A
from ..operators import display as D
from ..operators import documents as C
from ..operators import glyphs as Y
from ..operators import records as N
from ..operators import relational as R
from ..operators import segment as S
from ..operators import validate as V
from ..sources import readers
from .boxes import BOXES, FLAGGED, _boxes, _flagged
from .corpus import load
from .extra import FMT

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- parse errors


def _lines(spark, sf) -> DataFrame:
    """A conversation is a volume. By its number modulo 6: repeated record, no heading, no identifiers, unreadable ones,
    no content, and a stray line with an unknown marker."""
    v = F.col("conv_id")
    kind = v % 6
    code = (v % 90 + 10).cast("string")
    title, mark = F.concat(F.lit("RECORD "), (v % 1000).cast("string")), F.concat(F.lit("<"), code, F.lit(">"))
    none = F.expr("cast(array() as array<string>)")
    body = F.transform("l", lambda x: F.concat(F.lit("- "), F.coalesce(x["text"], F.lit(""))))
    opt = lambda cond, *cols: F.when(cond, F.array(*cols)).otherwise(none)
    record = F.concat(
        F.array(title), opt(kind == 5, F.lit("foo")), F.array(F.lit("Name: n")), opt(kind != 2, F.concat(F.lit("Ids: "), F.when(kind == 3, "none").otherwise(mark))),
        opt(kind != 1, F.lit("Text")), F.array(mark), F.when(kind == 4, none).otherwise(body), opt(kind == 5, F.lit("<5>"), F.lit("- x")),
    )
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return c.select(v.alias("volume"), F.posexplode(F.when(kind == 0, F.concat(record, record)).otherwise(record)).alias("line_no", "text"), F.lit(1).alias("page_number"))


V_SQL = "v AS (SELECT DISTINCT conv_id AS volume, conv_id % 6 AS k, (conv_id % 90 + 10)::VARCHAR AS code FROM conversations)"
ERRORS = "e AS (SELECT *, CASE k WHEN 1 THEN 'missing heading Text' WHEN 2 THEN 'missing metadata Ids' WHEN 3 THEN 'unreadable identifiers Ids' WHEN 4 THEN 'face <' || code || '> lacks Text' END AS error FROM v)"


@query(f"WITH {V_SQL}, {ERRORS} SELECT volume, 1::BIGINT AS rec, 'error' AS level, error AS text FROM e WHERE error IS NOT NULL UNION ALL SELECT volume, 1, 'warning', 'empty_marker' FROM v WHERE k = 4 UNION ALL SELECT volume, 1, 'warning', unnest(['before_metadata', 'unknown_marker']) FROM v WHERE k = 5")
def record_issues(spark, sf):
    return S.record_issues(S.parse_records(_lines(spark, sf), FMT, details=False)).withColumn("rec", F.col("rec").cast("long"))


@query(f"WITH {V_SQL}, {ERRORS} SELECT volume, CASE k WHEN 0 THEN 'repeated numbers' ELSE error END AS error FROM e WHERE k < 5")
def strict_errors(spark, sf):
    return S.first_errors(S.parse_records(_lines(spark, sf), FMT, details=False), FMT)


@query("WITH e AS (SELECT event_id, event_id % 100 AS n, event_id % 3 = 0 AS bad FROM events) SELECT count(*) FILTER (NOT bad) AS valid, count(DISTINCT n) FILTER (bad AND n <> 7) AS invalid, count(*) FILTER (bad AND n = 7) AS unassigned FROM e")
def extraction_summary(spark, sf):
    e = load(spark, sf, "events").select((F.col("event_id") % 100).alias("n"), (F.col("event_id") % 3 == 0).alias("bad"))
    issues = e.where("bad").select(F.nullif("n", F.lit(7)).alias("number"), F.array(F.lit("x")).alias("errors"))
    return A.extraction_summary(e.where("not bad").select(F.col("n").alias("number")), issues)


@query("SELECT o_custkey AS page_number, o_orderkey AS line_no, row_number() OVER (PARTITION BY o_custkey ORDER BY round_even(o_orderkey % 5 / 8.0::DOUBLE, 2), o_orderkey % 3, o_orderkey) AS place FROM orders")
def line_places(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_custkey").alias("page_number"), F.col("o_orderkey").alias("line_no"), (F.col("o_orderkey") % 5 / F.lit(8.0)).alias("y0"), (F.col("o_orderkey") % 3).alias("x0"))
    return S.line_places(d).select("page_number", "line_no", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- documents


@query(f"""WITH {BOXES}, g AS (SELECT image, count(*) AS n, bool_or(x2 > 150 OR y2 > 70) AS far, bool_or(idx = 6) AS six, bool_or(idx = 7) AS seven, bool_or(idx % 2 = 0 AND idx % 5 = 4) AS level FROM b GROUP BY 1)
SELECT image, 'box_ids' AS rule FROM g WHERE image % 5 = 0 UNION ALL SELECT image, 'annotation_keys' FROM g WHERE image % 7 = 0 UNION ALL SELECT image, 'bbox' FROM g WHERE far
UNION ALL SELECT image, 'damage_level' FROM g WHERE level UNION ALL SELECT image, 'flags' FROM g WHERE six UNION ALL SELECT image, 'annotation' FROM g WHERE seven UNION ALL SELECT image, 'crop' FROM g WHERE image % 11 = 0""")
def document_violations(spark, sf):
    i, image = F.col("idx"), F.col("image")
    hurt = F.when(i % 2 == 1, "damaged").otherwise("intact")
    box = F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), hurt.alias("status"), F.when(i % 5 == 4, 2).alias("damage_level"), (i == 6).alias("unknown"), *[F.lit(False).alias(f) for f in V.OTHERS])
    name = F.when(image % 5 == 0, i + 1).otherwise(i).cast("string")
    g = _boxes(spark, sf).groupBy("image").agg(F.collect_list(F.struct(name.alias("k"), box.alias("v"))).alias("b"), F.collect_list(F.struct(name.alias("k"), F.when(i == 7, "ab").otherwise("x").alias("v"))).alias("a"))
    notes = F.when(image % 7 == 0, F.transform("a", lambda e: F.struct(F.concat(F.lit("0"), e["k"]).alias("k"), e["v"].alias("v")))).otherwise(F.col("a"))
    right = F.when(image % 11 == 0, 0.0).otherwise(9.0)
    crop = G.corners(G.Box(F.lit(0.0), F.lit(0.0), right, F.lit(9.0)))
    docs = g.select("image", F.lit(150).alias("width"), F.lit(70).alias("height"), F.map_from_entries("b").alias("bounding_boxes"), F.map_from_entries(notes).alias("annotations"), crop.alias("crop"))
    return V.document_violations(docs)


@query(f"""WITH {FLAGGED} SELECT event_id, CASE WHEN status = 'damaged' THEN damage_level END AS damage_level, unknown AND status = 'damaged' AND event_id % 5 <> 0 AS unknown,
  unavailable_font AND event_id % 5 <> 0 AS unavailable_font, expert_prediction AND event_id % 5 <> 0 AS expert_prediction, suspicious AND event_id % 5 <> 0 AS suspicious FROM f""")
def flag_normalize(spark, sf):
    d = _flagged(spark, sf).withColumn("token", F.when(F.col("event_id") % 5 == 0, T.MISSING).otherwise("x"))
    return V.normalized_flags(d, "token").select("event_id", "damage_level", *V.FLAGS)


@query("""WITH d AS (SELECT doc_id, doc_id || '.jpg' AS image FROM documents) SELECT image, 'image' AS rule FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT image, 'inscription_code' FROM d WHERE doc_id % 7 = 0 OR doc_id % 5 = 0
UNION ALL SELECT image, 'headings' FROM d WHERE doc_id % 9 = 0 UNION ALL SELECT image, 'content' FROM d WHERE doc_id % 9 = 1 UNION ALL SELECT image, 'sections' FROM d WHERE doc_id % 9 IN (0, 2)""")
def content_violations(spark, sf):
    k = F.col("doc_id")
    text = lambda *heads: F.create_map(*[x for h in heads for x in (F.lit(h), F.col("text"))])
    docs = load(spark, sf, "documents").select(
        F.concat(k.cast("string"), F.lit(".jpg")).alias("image"), F.when(k % 7 == 0, "z").otherwise(k.cast("string")).alias("inscription_code"),
        F.when(k % 9 == 0, text("A", "")).when(k % 9 == 2, text("A")).when(k % 9 != 1, text("B", "A")).alias("content"),
        F.concat(F.lit("a/b/"), F.when(k % 5 == 0, "other").otherwise(k.cast("string")), F.lit(".jpg")).alias("asked"),
    )
    return C.content_violations(docs, ["A", "B"])


@query(f"WITH {BOXES} SELECT image, idx::VARCHAR AS id FROM b WHERE x1 % 13 = 0")
def suspicious_boxes(spark, sf):
    g = _boxes(spark, sf).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string"), F.struct((F.col("x1") % 13 == 0).alias("suspicious"))))).alias("bounding_boxes"))
    return C.suspicious_boxes(g)


@query("""WITH p AS (SELECT p_partkey AS image, replace(p_brand, '#', '') AS t, p_partkey % 3 AS k, p_partkey % 5 <> 0 AS restored, p_partkey % 4 <> 1 AS same FROM part)
SELECT image, restored, restored AND same AS aligned, CASE WHEN restored AND same THEN CASE k WHEN 1 THEN t ELSE reverse(t) || CASE k WHEN 2 THEN 'MISS' ELSE '' END END END AS sequence FROM p""")
def hydrated_documents(spark, sf):
    """Signs are the text's from behind; text in excess is kept whole, boxes in excess have a missing sign."""
    p, k = load(spark, sf, "part"), F.col("p_partkey")
    p = p.select(k.alias("image"), F.regexp_replace("p_brand", "#", "").alias("text"), (k % 3).alias("k"), (k % 4 == 1).alias("odd"), (k % 5 == 0).alias("old"))
    chars = F.split("text", "")
    signs = F.when(F.col("k") == 1, F.slice(F.reverse(chars), 1, 5)).when(F.col("k") == 2, F.concat(F.reverse(chars), F.array(F.lit(T.MISSING)))).otherwise(F.reverse(chars))
    wrong = lambda a: F.when(F.col("odd"), F.transform(a, lambda c, i: F.when(i == 0, "~").otherwise(c))).otherwise(a)
    p = p.withColumn("signs", wrong(signs)).withColumn("boxes", F.transform("signs", lambda c, i: (i + 1).cast("string")))
    saved = p.select(
        "image", F.when(F.col("old"), "old").otherwise(T.fingerprint(F.col("text"))).alias("fingerprint"), F.when(F.col("k") == 1, "extra_text").when(F.col("k") == 2, "missing_text").alias("issue_type"),
        "boxes", F.map_from_arrays("boxes", "signs").alias("annotations"), wrong(chars).alias("text_sequence"),
    )
    return C.hydrated(saved, p.select("image", "text")).select("image", "restored", "aligned", F.array_join("sequence", "").alias("sequence"))


PAYLOADS = [
    ("boxes", '{"boxes": {"a": [1, 2, 3, 4], "b": {"bbox": [1, 2, 3, 4]}}}', None), ("boxes", '{"boxes": {"a": [1, 2, 3]}}', "boxes"), ("boxes", '{"selected": {}}', "selected"), ("boxes", "[]", "json"), ("boxes", "", None),
    ("crop", '{"crop": [0, 1, 2.5, 3]}', None), ("crop", '{"crop": [0, 1, true, 3]}', "crop"), ("crop", '{"crop": [0, 1, 2]}', "crop"), ("crop", '{"crop": null}', None),
    ("sequence", '{"textSequence": ["a", ""]}', "textSequence"), ("sequence", '{"tokenOrder": [1]}', "tokenOrder"), ("sequence", '{"textSequence": ["a"], "tokenOrder": ["1"]}', None),
    ("status", '{"statuses": {"1": "broken"}}', "statuses"), ("status", '{"unknowns": {"1": 1}}', "unknowns"), ("status", '{"damage_levels": {"1": true}}', "damage_levels"), ("status", '{"damage_levels": {"1": 3, "2": null}}', None),
    ("status", "{", "json"), ("other", "{}", "kind"),
]


@query(f"SELECT event_id, [{', '.join('NULL' if p[2] is None else repr(p[2]) for p in PAYLOADS)}][event_id % {len(PAYLOADS)} + 1] AS problem FROM events")
def payload_problems(spark, sf):
    at = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PAYLOADS]), (F.col("event_id") % len(PAYLOADS) + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", C.payload_problems(at(0), at(1)).alias("problem"))


@query("""WITH j AS (SELECT o_orderkey, json_object('a', json_object('k', json_array(o_orderkey, o_orderpriority, NULL, json_object('c', json_array(o_orderstatus)))), 'e', json_object(), 't', true, 'n', o_custkey) AS d FROM orders)
SELECT o_orderkey, t.fullkey AS path, t.atom->>'$' AS value FROM j, json_tree(j.d) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def tree_leaves(spark, sf):
    s = lambda c: F.to_json(F.array(c))
    doc = F.concat(F.lit('{"a": {"k": ['), F.col("o_orderkey").cast("string"), F.lit(', '), F.substring(s("o_orderpriority"), F.lit(2), F.length(s("o_orderpriority")) - 2), F.lit(', null, {"c": '), s("o_orderstatus"), F.lit('}]}, "e": {}, "t": true, "n": '), F.col("o_custkey").cast("string"), F.lit("}"))
    return N.tree_leaves(load(spark, sf, "orders").select("o_orderkey", doc.alias("doc")), "doc")


# ---------------------------------------------------------------- fonts and files

ENDINGS = ("BoldItalic", "-Regular", "Oblique", "", "Italic", ",Bold", "Normal")
FONTS = f"n AS (SELECT p_partkey, p_name || [{', '.join(map(repr, ENDINGS))}][p_partkey % {len(ENDINGS)} + 1] AS font FROM part)"


def _fonts(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (k % len(ENDINGS) + 1).cast("int"))).alias("font"))


@query(f"""WITH {FONTS}, k AS (SELECT p_partkey, regexp_replace(lower(font), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM n), m AS (SELECT *, '^(.+?)(bolditalic|regular|oblique|italic|normal|bold)$' AS p FROM k)
SELECT p_partkey, CASE WHEN regexp_matches(key, p) THEN regexp_extract(key, p, 1) ELSE key END AS family, nullif(regexp_extract(key, p, 2), '') AS style FROM m""")
def font_styles(spark, sf):
    return _fonts(spark, sf).select("p_partkey", T.font_style(F.concat(F.lit("ABCDEF+"), F.col("font"))).alias("f")).select("p_partkey", "f.family", "f.style")


@query(f"WITH {FONTS} SELECT p_partkey, contains(font, 'Bold') OR contains(font, 'ar') AS held, p_partkey % 3 = 0 AS same FROM n")
def encoded_fonts(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, "ABCDEF+Times-New Roman").otherwise("TimesNewRomanPS")
    return _fonts(spark, sf).select("p_partkey", Y.encoded_font(F.col("font"), ["Bold", "ar"]).alias("held"), Y.encoded_font(name, ["times new roman"], exact=True).alias("same"))


@query("SELECT p_brand || p_size AS stem, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_stems(spark, sf):
    return readers.repeated_stems(load(spark, sf, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("stem")))


@query("""SELECT 's' || p_partkey AS signature, '"s' || p_partkey || '": {"glyph":"g' || p_size || '","codepoint":' || (p_size + 65) || ',"unicode":"U+","char":"' || chr(p_size % 26 + 65) || '"}' AS member FROM part""")
def profile_members(spark, sf):
    p = load(spark, sf, "part")
    code = F.col("p_size").cast("int")
    return Y.profile_json(p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("signature"), F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("glyph"), (code + 65).alias("codepoint"), F.lit("U+").alias("unicode"), F.char(code % 26 + 65).alias("char")))


# ---------------------------------------------------------------- sizes, tokens


@query("""WITH s AS (SELECT o_orderkey, 200 + o_orderkey % 900 AS w, 100 + o_custkey % 700 AS h FROM orders), r AS (SELECT *, least(640::DOUBLE / w, 640::DOUBLE / h) AS r FROM s),
n AS (SELECT *, round_even(w * r, 0)::INT AS new_w, round_even(h * r, 0)::INT AS new_h FROM r), p AS (SELECT *, ((640 - new_w) % 32) / 2::DOUBLE AS pad_x, ((640 - new_h) % 32) / 2::DOUBLE AS pad_y FROM n)
SELECT o_orderkey, round(r, 9) AS ratio, new_w, new_h, pad_x, pad_y, round_even(pad_x - 0.1::DOUBLE, 0)::INT AS "left", round_even(pad_x + 0.1::DOUBLE, 0)::INT AS "right", round_even(pad_y - 0.1::DOUBLE, 0)::INT AS top, round_even(pad_y + 0.1::DOUBLE, 0)::INT AS bottom FROM p""")
def letterbox(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", *G.letterbox(200 + F.col("o_orderkey") % 900, 100 + F.col("o_custkey") % 700))
    return d.withColumn("ratio", F.round("ratio_w", 9)).drop("ratio_w", "ratio_h")


@query(f"WITH {BOXES} SELECT image, idx, greatest(0, least(x1 - 20, x2 - 1)) AS x1, y1, x2, least(60, greatest(y2 + 15, y1 + 1)) AS y2 FROM b")
def corner_resize(spark, sf):
    b = G.Box.of()
    return _boxes(spark, sf).select("image", "idx", *G.corner_resized(b, "bottom_left", F.col("x1") - 20, F.col("y2") + 15, F.lit(200.0), F.lit(60.0)))


@query(f"WITH {BOXES} SELECT image, idx, x1, y1, x2, y2, idx % 3 <> 0 AS rectangle FROM b")
def crop_corners(spark, sf):
    d = _boxes(spark, sf).withColumn("c", G.corners(G.Box.of()))
    skew = F.col("c").withField("top_right", F.array(F.col("x2"), F.col("y1") - 1))
    d = d.withColumn("c", F.when(F.col("idx") % 3 == 0, skew).otherwise(F.col("c")))
    ok, box = G.from_corners(F.col("c"))
    return d.select("image", "idx", *box, ok.alias("rectangle"))


TOKENS = f"WITH {BOXES}, t AS (SELECT image, idx, CASE WHEN x1 % 3 = 0 THEN 'MISS' ELSE 'x' END AS t, x1, lag(x1 % 3 = 0, 1, false) OVER (PARTITION BY image ORDER BY idx) AS after FROM b)"


def _tokens(spark, sf) -> DataFrame:
    return _boxes(spark, sf).select("image", "idx", "x1", F.when(F.col("x1") % 3 == 0, T.MISSING).otherwise("x").alias("t"))


def _in_order(value: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", value))), lambda e: e[value])


@query(f"{TOKENS} SELECT image, string_agg(CASE WHEN t = 'MISS' AND after THEN ' ' ELSE '' END || t, '' ORDER BY idx) AS text FROM t GROUP BY 1")
def missing_spacing(spark, sf):
    return _tokens(spark, sf).groupBy("image").agg(_in_order("t").alias("t")).select("image", D.missing_spacing(F.col("t")).alias("text"))


@query(f"{TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x1, idx) AS at FROM t) SELECT r.image, r.idx, t.t AS token FROM r JOIN t ON t.image = r.image AND t.idx = r.at")
def token_of_box(spark, sf):
    d = _tokens(spark, sf)
    g = d.groupBy("image").agg(_in_order("t").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("x1", "idx"))), lambda e: e["idx"]).alias("order"))
    return d.select("image", "idx").join(g, "image").select("image", "idx", D.token_of_box(F.col("order"), F.col("tokens"), F.col("idx")).alias("token"))


@query(f"""WITH {BOXES}, c AS (SELECT image, idx, idx * 10 + 20 * (x1 % 2) AS y1 FROM b), g AS (SELECT *, y1 - lag(y1 + 8) OVER (PARTITION BY image ORDER BY idx) AS gap FROM c)
SELECT image, string_agg(CASE WHEN gap > 12 THEN ' ' ELSE '' END || 'x', '' ORDER BY idx) AS text FROM g GROUP BY 1""")
def spaced_text(spark, sf):
    y = F.col("idx") * 10 + 20 * (F.col("x1") % 2)
    return D.spaced_text(_boxes(spark, sf).select("image", F.col("idx").alias("pos"), y.alias("y1"), (y + 8).alias("y2"), F.lit("x").alias("char")), ["image"])


@query(f"{TOKENS} SELECT image, idx, t AS token, idx > 4 AS excluded FROM t")
def align_extra(spark, sf):
    d = _tokens(spark, sf)
    return R.align(d.select("image", "idx", F.col("t").alias("token")), d.where("idx <= 4").select("image", "idx"), "image", "idx").select("image", "idx", "token", "excluded")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def status_review(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise(F.col("o_orderstatus"))
    return A.review(load(spark, sf, "orders").select("o_orderkey", status.alias("status")))
