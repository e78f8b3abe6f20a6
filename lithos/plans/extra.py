"""Queries over flags, crops, names, fonts, sessions and parsed records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import boxes as B
from ..operators import display as D
from ..operators import glyphs as Y
from ..operators import records as N
from ..operators import segment as S
from ..operators import validate as V
from ..operators import workflow as W
from ..sources import readers
from ..sources.sinks import text_problems as problems
from .boxes import BOXES, FLAGGED, _boxes, _flagged
from .corpus import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- geometry


@query(f"WITH {BOXES}, c AS (SELECT image, idx, least(greatest(x1 - 30, 0), 89) AS x1, least(greatest(y1 - 10, 0), 39) AS y1, x2, y2 FROM b) SELECT image, idx, x1, y1, greatest(least(x2, 90), x1 + 1) AS x2, greatest(least(y2, 40), y1 + 1) AS y2 FROM c")
def constrain_crop(spark, sf):
    b = G.Box(F.col("x1") - 30, F.col("y1") - 10, F.col("x2"), F.col("y2"))
    return _boxes(spark, sf).select("image", "idx", *G.constrained(b, F.lit(90.0), F.lit(40.0)))


@query(f"WITH {BOXES} SELECT image, idx, (x1 - 5) * 2 AS x1, (y1 - 7) * 0.5 AS y1, (x2 - 5) * 2 AS x2, (y2 - 7) * 0.5 AS y2 FROM b")
def review_transform(spark, sf):
    return _boxes(spark, sf).select("image", "idx", *G.transformed(G.Box.of(), F.lit(5.0), F.lit(7.0), F.lit(2.0), F.lit(0.5)))


@query(f"WITH {BOXES}, m AS (SELECT *, least(greatest(-50, -x1), 200 - x2) AS dx, least(greatest(90, -y1), 100 - y2) AS dy FROM b) SELECT image, idx, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2 FROM m")
def group_move(spark, sf):
    return _boxes(spark, sf).select("image", "idx", *G.moved(G.Box.of(), F.lit(-50.0), F.lit(90.0), F.lit(200.0), F.lit(100.0)))


@query(f"WITH {BOXES} SELECT image, idx, least(greatest((x1 - 8) / 0.5, 0), 150) AS x1, least(greatest((y1 - 4) / 0.5, 0), 60) AS y1, least(greatest((x2 - 8) / 0.5, 0), 150) AS x2, least(greatest((y2 - 4) / 0.5, 0), 60) AS y2 FROM b")
def unletterbox(spark, sf):
    f = lambda v: F.lit(float(v))
    return _boxes(spark, sf).select("image", "idx", *G.unletterbox(G.Box.of(), f(0.5), f(8), f(4), f(150), f(60)))


@query(f"WITH {BOXES} SELECT image, idx, x1 - x2 / 2 AS x1, y1 - y2 / 2 AS y1, x1 + x2 / 2 AS x2, y1 + y2 / 2 AS y2 FROM b")
def center_boxes(spark, sf):
    return _boxes(spark, sf).select("image", "idx", *G.from_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


@query(f"WITH {BOXES} SELECT image, idx FROM b WHERE x2 - x1 >= 30 AND y2 - y1 >= 20 AND idx * 60 >= 150")
def strip_filter(spark, sf):
    return B.face_candidates(_boxes(spark, sf).withColumn("pixel_width", F.col("idx") * 60), 30, 20, 150).select("image", "idx")


@query("""WITH p AS (SELECT l_orderkey AS image, l_partkey AS idx, l_suppkey AS k2, l_quantity AS q, l_discount * 10 AS o, [l_tax * 12, l_discount * 9, 0.4] AS s FROM lineitem),
e AS (SELECT image, idx, k2, q, generate_subscripts(s, 1) - 1 AS cls, unnest(s) * o AS score FROM p WHERE o > 0.3)
SELECT image, idx, k2, q, cls::INT AS cls, round(score, 9) AS score FROM e WHERE score > 0.3""")
def class_confidence(spark, sf):
    p = load(spark, sf, "lineitem").select(
        F.struct(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q")).alias("image"), F.lit(0).alias("idx"),
        *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("l_discount") * 10).alias("objectness"), F.array(F.col("l_tax") * 12, F.col("l_discount") * 9, F.lit(0.4)).alias("scores"),
    )
    return B.confident(p, 0.3, 3).select(F.col("image.i").alias("image"), F.col("image.p").alias("idx"), F.col("image.s").alias("k2"), F.col("image.q").alias("q"), "cls", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- flags and gates


@query(f"""WITH {FLAGGED}, o AS (SELECT *, event_id % 5 = 0 AS ou, event_id % 7 = 0 AS oa, event_id % 22 = 0 AS oe, event_id % 26 = 0 AS os FROM f),
n AS (SELECT *, unknown AND NOT ou AS fu, unavailable_font AND NOT oa AS fa, expert_prediction AND NOT oe AS fe, suspicious AND NOT os AS fs FROM o)
SELECT event_id, unknown AND (fu OR NOT (fa OR fe OR fs)) AS unknown, unavailable_font AND NOT fu AS unavailable_font, expert_prediction AND NOT fu AS expert_prediction, suspicious AND NOT fu AS suspicious,
  CASE WHEN fe AND NOT fu THEN 'damaged' ELSE status END AS status FROM n""")
def flag_update(spark, sf):
    e = F.col("event_id")
    d = _flagged(spark, sf)
    d = d.select("event_id", F.col("status").alias("new_status"), *[F.col(f).alias(f"new_{f}") for f in V.FLAGS], (e % 5 == 0).alias("old_unknown"), (e % 7 == 0).alias("old_unavailable_font"), (e % 22 == 0).alias("old_expert_prediction"), (e % 26 == 0).alias("old_suspicious"))
    return V.updated_flags(d).select("event_id", *V.FLAGS, "status")


@query(f"WITH {FLAGGED}, t AS (SELECT *, CASE event_id % 3 WHEN 0 THEN '□' WHEN 1 THEN '@' ELSE 'x' END AS tok FROM f) SELECT event_id, CASE tok WHEN '□' THEN status = 'damaged' AND unknown WHEN '@' THEN unavailable_font ELSE true END AS ok FROM t")
def placeholder_rules(spark, sf):
    tok = F.when(F.col("event_id") % 3 == 0, "□").when(F.col("event_id") % 3 == 1, "@").otherwise("x")
    return _flagged(spark, sf).withColumn("tok", tok).select("event_id", V.placeholder_ok(F.col("tok")).alias("ok"))


@query("SELECT doc_id AS image, (doc_id % 4)::INT AS revision, doc_id % 4 = coalesce(quality, -1) AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def stale_revisions(spark, sf):
    r = load(spark, sf, "documents").select(F.col("doc_id").alias("image"), (F.col("doc_id") % 4).cast("int").alias("revision"))
    return W.fresh(r, load(spark, sf, "labels").select(F.col("doc_id").alias("image"), F.col("quality").alias("revision")))


@query("SELECT doc_id AS image, doc_id % 3 <> 0 AS restored FROM documents")
def restored_alignment(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("image"), "text")
    saved = d.select("image", F.when(F.col("image") % 3 != 0, T.fingerprint(F.col("text"))).otherwise("old").alias("fingerprint"))
    return W.restored(saved, d).select("image", "restored")


@query("SELECT doc_id, 'text' AS column FROM documents WHERE regexp_matches(replace(text, chr(10), ''), '[\\x{FFFD}\\p{Cc}]')")
def text_problems(spark, sf):
    return problems(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query()
def workflow_replay(spark, sf):
    e = load(spark, sf, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    act = F.element_at(F.array(*[F.lit(a) for a in ("save_content", "detect", "sort_boxes", "next", "statuses", "next", "crop", "next", "save")]), F.least(step, F.lit(9)))
    body = F.element_at(F.array(*[F.lit(p) for p in ('{"text": "ab"}', '{"boxes": [[0, 0, 5, 5], [0, 6, 5, 9]], "damaged": 1}', '{"order": [2, 1]}', "{}", '{"ids": [1], "damaged": true, "level": 2}', "{}", '{"bbox": [0, 0, 9, 9]}', "{}", "{}")]), F.least(step, F.lit(9)))
    log = e.select(F.col("user_id").cast("string").alias("session"), step.cast("long").alias("seq"), act.alias("action"), body.alias("payload"), F.lit(None).cast("int").alias("revision"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return W.replay(log).select("session", "seq", "accepted", "reason")


# ---------------------------------------------------------------- names, fonts, files

NAMES = "n AS (SELECT o_orderkey, 'Tap-' || o_orderkey % 4 || '_x' || CASE o_orderkey % 6 WHEN 0 THEN '_valid' WHEN 1 THEN '_Manual-Review' WHEN 2 THEN '_tag-corrected' WHEN 3 THEN '' WHEN 4 THEN '_invalid' ELSE '.bak' END || '.json' AS file FROM orders)"


@query(f"""WITH {NAMES} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN regexp_replace(file, '[.]json$', '') ELSE regexp_extract(file, '^(Tap-[0-9]+_x)', 1) END AS prefix,
CASE o_orderkey % 6 WHEN 1 THEN 'manual-review' WHEN 2 THEN 'tag-corrected' ELSE 'valid' END AS kind, CASE o_orderkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS priority, (o_orderkey % 4)::INT AS volume FROM n WHERE o_orderkey % 6 <> 4""")
def file_classes(spark, sf):
    k = F.col("o_orderkey")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("_valid", "_Manual-Review", "_tag-corrected", "", "_invalid", ".bak")]), (k % 6 + 1).cast("int"))
    f = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Tap-"), (k % 4).cast("string"), F.lit("_x"), tail, F.lit(".json")).alias("file"))
    return readers.classify(f).select("o_orderkey", "prefix", "kind", "priority", readers.volume_number(F.col("file")).alias("volume"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM part")
def font_keys(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.font_key(F.concat(F.lit("ABCDEF+"), F.col("p_name"))).alias("key"))


@query("SELECT p_brand AS key, arg_min(p_name || '#' || p_partkey, (p_size, p_name || '#' || p_partkey)) AS file FROM part GROUP BY 1")
def best_reference(spark, sf):
    p = load(spark, sf, "part")
    refs = p.select(F.col("p_brand").alias("key"), F.col("p_size").alias("style_priority"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("file"))
    return Y.best_reference(p.select(F.col("p_brand").alias("key")).distinct(), refs)


@query("SELECT l_suppkey % 20 AS page, nullif(l_partkey % 7, 3) AS xref, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1, 2")
def miss_counts(spark, sf):
    d = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("page"), F.nullif(F.col("l_partkey") % 7, F.lit(3)).alias("xref"), F.when(F.col("l_partkey") % 3 == 0, "matched").otherwise("fallback").alias("status"))
    return Y.miss_counts(d, ["page", "xref"])


@query("SELECT l_orderkey, string_agg(c, '' ORDER BY l_linenumber) AS t FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def annotations_text(spark, sf):
    m = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("c"))
    m = m.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "c"))).alias("m"))
    return m.select("l_orderkey", D.annotations_text(F.col("m")).alias("t"))


@query("""WITH c AS (SELECT conv_id, role, max(text) AS text, count(*) AS n FROM conversations GROUP BY 1, 2), t AS (SELECT unnest(['user', 'tool']) AS title, unnest([0, 1]) AS pos)
SELECT i.conv_id, t.pos::INT AS pos, t.title AS label, coalesce(CASE WHEN c.n = 1 THEN c.text END, '') AS value FROM (SELECT DISTINCT conv_id FROM conversations) i CROSS JOIN t LEFT JOIN c ON c.conv_id = i.conv_id AND c.role = t.title""")
def content_fields(spark, sf):
    s = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("s"))
    s = s.select("conv_id", F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("sections"))
    return N.content_fields(s, ["conv_id"], ["user", "tool"], {}).select("conv_id", "pos", "label", "value")


@query("SELECT conv_id, count(*) + CASE WHEN count_if(role = 'tool') = 0 THEN 1 ELSE 0 END AS n FROM conversations GROUP BY 1")
def content_completion(spark, sf):
    s = load(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("title"), "text")).alias("sections"))
    return N.completed(s, ["tool"], []).select("conv_id", F.size("sections").cast("long").alias("n"))


FMT = S.RecordFormat("^RECORD (\\d+)$", "Text", ("Text", "Reading"), (S.Field("Name", "name"), S.Field("Ids", "ids", "identifiers", True)))


@query("""SELECT conv_id AS volume, 1::BIGINT AS rec, (conv_id % 1000)::INT AS number, (conv_id % 90 + 10)::VARCHAR AS ids, count(*) FILTER (regexp_matches(text, '[^\\s]')) > 0 AS has_text FROM conversations GROUP BY 1, 3, 4""")
def parsed_records(spark, sf):
    c = load(spark, sf, "conversations")
    v = F.col("conv_id")
    head = F.array(F.concat(F.lit("RECORD "), (v % 1000).cast("string")), F.lit("Name: n"), F.concat(F.lit("Ids: <"), (v % 90 + 10).cast("string"), F.lit(">")), F.lit("Text"), F.concat(F.lit("<"), (v % 90 + 10).cast("string"), F.lit(">")))
    body = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    rows = body.select(v.alias("volume"), F.posexplode(F.concat(head, F.transform("l", lambda x: F.concat(F.lit("- "), x["text"])))).alias("line_no", "text"), F.lit(1).alias("page_number"))
    p = S.parse_records(rows, FMT)
    return p.select("volume", "rec", "number", F.array_join("ids", ",").alias("ids"), (F.length(F.get(F.get("faces", F.lit(0))["sections"], F.lit(0))["text"]) > 2).alias("has_text"))
