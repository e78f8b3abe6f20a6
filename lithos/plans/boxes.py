"""Queries over boxes, ordinals, glyphs and constraints. Each has the SQL that checks it, but for the two
sequential ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import graphemes
from ..operators import boxes as B
from ..operators import glyphs as Y
from ..operators import missing as M
from ..operators import reading
from ..operators import records as N
from ..operators import relational as R
from ..operators import validate as V
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


def _boxes(spark, sf) -> DataFrame:
    """Boxes from whole columns of lineitem; an order is an image."""
    x, y = (F.col("l_partkey") % 120).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    w, h = 10 + F.floor("l_quantity") % 50, 10 + F.col("l_partkey") % 37
    # the window is by the name that later steps use, which then find the rows dealt already
    i = F.row_number().over(Window.partitionBy("image").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return load(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "image").select("image", i.alias("idx"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), (F.col("l_discount") * 10).alias("score"))


BOXES = """b AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx,
  (l_partkey % 120)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, (l_partkey % 120 + 10 + floor(l_quantity) % 50)::DOUBLE AS x2, (l_suppkey % 40 + 10 + l_partkey % 37)::DOUBLE AS y2, l_discount * 10 AS score FROM lineitem)"""
D = "d AS (SELECT * FROM b WHERE idx % 2 = 1), o AS (SELECT * FROM b WHERE idx % 2 = 0)"
INTER = "(greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0))"
AREA_A, AREA_C = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((c.x2 - c.x1) * (c.y2 - c.y1))"
PAIRS = f"p AS (SELECT a.image, a.idx AS d, c.idx AS o, {INTER} / ({AREA_A} + {AREA_C} - {INTER}) AS iou, {INTER} / least({AREA_A}, {AREA_C}) AS cover, c.x1 AS px1, c.y1 AS py1, c.x2 AS px2, c.y2 AS py2 FROM d a JOIN o c ON a.image = c.image)"


@query(f"WITH {BOXES}, {D}, {PAIRS} SELECT image, d, o, round(iou, 6) AS iou, round(cover, 6) AS coverage FROM p WHERE cover > 0")
def iou_pairs(spark, sf):
    b = _boxes(spark, sf)
    d, o = b.where("idx % 2 = 1"), b.where("idx % 2 = 0")
    p = B.meeting(B.prefixed(d, "image", "idx", "d"), B.prefixed(o, "image", "idx", "o"), "image", "d_", "o_").where(G.intersection(G.Box.of("d_"), G.Box.of("o_")) > 0)
    return p.select("image", "d", "o", F.round(G.iou(G.Box.of("d_"), G.Box.of("o_")), 6).alias("iou"), F.round(G.coverage(G.Box.of("d_"), G.Box.of("o_")), 6).alias("coverage"))


@query(f"""WITH {BOXES}, {D}, {PAIRS},
same AS (SELECT DISTINCT image, o FROM p WHERE iou >= 0.5),
pro AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY image, d ORDER BY cover DESC, o) AS rn FROM p WHERE iou < 0.5 AND cover >= 0.8 AND (image, o) NOT IN (SELECT (image, o) FROM same)) WHERE rn = 1),
kept AS (SELECT d.image, d.idx, coalesce(px1, x1) AS x1, coalesce(py1, y1) AS y1, coalesce(px2, x2) AS x2, coalesce(py2, y2) AS y2, o FROM d LEFT JOIN pro ON pro.image = d.image AND pro.d = d.idx),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, coalesce(o, -1 - idx) ORDER BY idx) AS rn FROM kept) WHERE rn = 1)
SELECT image, 'damaged' AS status, idx, x1, y1, x2, y2 FROM one UNION ALL
SELECT image, 'intact', idx, x1, y1, x2, y2 FROM o WHERE (image, idx) NOT IN (SELECT (image, o) FROM same UNION SELECT (image, o) FROM pro)""")
def fuse_boxes(spark, sf):
    b = _boxes(spark, sf).drop("score")
    return B.fuse(b.where("idx % 2 = 1"), b.where("idx % 2 = 0"))


@query(f"WITH {BOXES} SELECT image, idx, round_even(x1 / 4, 0)::BIGINT AS x1, round_even(y1 / 4, 0)::BIGINT AS y1, round_even(x2 / 4, 0)::BIGINT AS x2, round_even(y2 / 4, 0)::BIGINT AS y2 FROM b WHERE score > 0.3")
def damage_filter(spark, sf):
    return B.damage_boxes(_boxes(spark, sf).withColumns({c: F.col(c) / 4 for c in ("x1", "y1", "x2", "y2")}))


@query(f"WITH {BOXES} SELECT image, idx, x1 >= 0 AND x1 < x2 AND x2 <= 150 AND y1 >= 0 AND y1 < y2 AND y2 <= 70 AS ok FROM b")
def bbox_valid(spark, sf):
    return _boxes(spark, sf).select("image", "idx", G.valid(G.Box.of(), F.lit(150), F.lit(70)).alias("ok"))


@query("WITH s AS (SELECT page_id, (page_id * 37 % 6000 + 1)::DOUBLE AS w, (page_id * 91 % 5000 + 1)::DOUBLE AS h FROM pages) SELECT page_id, greatest(round_even(w * least(1.0, 4096.0 / greatest(w, h)), 0), 1)::INT AS width, greatest(round_even(h * least(1.0, 4096.0 / greatest(w, h)), 0), 1)::INT AS height FROM s")
def crop_scale(spark, sf):
    p = F.col("page_id")
    b = G.Box(F.lit(0.0), F.lit(0.0), (p * 37 % 6000 + 1).cast("double"), (p * 91 % 5000 + 1).cast("double"))
    _, w, h = G.crop_size(b)
    return load(spark, sf, "pages").select("page_id", w.alias("width"), h.alias("height"))


@query("SELECT page_id, round((page_id * 37 % 4000 + 1)::DOUBLE / (page_id * 91 % 5000 + 1), 8) AS scale FROM pages")
def resize_meta(spark, sf):
    p = F.col("page_id")
    return load(spark, sf, "pages").select("page_id", G.resize_scale((p * 37 % 4000 + 1).cast("double"), p * 91 % 5000 + 1).alias("scale"))


@query(f"WITH {BOXES} SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY (x1 + x2) / 2 DESC, (y1 + y2) / 2, idx) AS reading_pos FROM b")
def reading_order_simple(spark, sf):
    return B.simple_order(_boxes(spark, sf)).select("image", "idx", "reading_pos")


@query(f"WITH {BOXES} SELECT image, idx FROM b WHERE x1 <= 40 + image % 50 AND 20 <= x2 AND y1 <= 30 AND 15 <= y2")
def hit_test(spark, sf):
    b = _boxes(spark, sf)
    area = load(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.lit(20.0).alias("x1"), F.lit(15.0).alias("y1"), (40 + F.col("o_orderkey") % 50).cast("double").alias("x2"), F.lit(30.0).alias("y2"))
    return B.grouped_hits(b, area, "image").select("image", "idx").distinct()


SQL["hit_test"] = SQL["hit_test"].replace("SELECT image, idx FROM b", "SELECT DISTINCT image, idx FROM b SEMI JOIN orders ON o_orderkey = image")


@query("""WITH p AS (SELECT event_id, user_id % 20 AS g, event_id * 7 % 9000 AS v FROM events), s AS (SELECT c_custkey AS span, c_custkey % 20 AS g, c_custkey * 13 % 9000 AS a, c_custkey * 13 % 9000 + 40 + c_custkey % 200 AS e FROM customer)
SELECT event_id, span FROM p JOIN s ON p.g = s.g AND v >= a AND v < e""")
def range_join_intervals(spark, sf):
    p = load(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("g"), (F.col("event_id") * 7 % 9000).alias("at"))
    c = F.col("c_custkey")
    s = load(spark, sf, "customer").select(c.alias("span"), (c % 20).alias("g"), (c * 13 % 9000).alias("start"), (c * 13 % 9000 + 40 + c % 200).alias("end"))
    return R.interval_join(p, s, "g", 200).select("event_id", "span")


# ---------------------------------------------------------------- ordinals

TOKENS = "tok AS (SELECT item_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT item_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM benchmark))"
BX = "bx AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey AS box FROM lineitem)"


def _tokens(spark, sf) -> DataFrame:
    t = F.split(F.regexp_replace("text", "\\s+", " "), " ")
    return load(spark, sf, "benchmark").select("item_id", F.posexplode(t).alias("p", "token")).select("item_id", (F.col("p") + 1).alias("pos"), "token")


@query(f"""WITH {TOKENS}, {BX}, ot AS (SELECT o_orderkey AS item, pos, token FROM orders JOIN tok ON item_id = o_orderkey % 40)
SELECT item, pos, token, box, box IS NULL AS excluded FROM ot FULL JOIN bx USING (item, pos)""")
def align_positional(spark, sf):
    """Every order is an item: its lines are boxes, and its tokens those of one of the 40 benchmark texts."""
    texts = load(spark, sf, "benchmark").select("item_id", F.split(F.regexp_replace("text", "\\s+", " "), " ").alias("tokens"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    bx = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_partkey"]).alias("boxes"))
    both = load(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 40).alias("item_id")).join(bx, "item", "full")
    return R.align_rows(both.join(F.broadcast(texts), "item_id", "left").drop("item_id"), "item")


@query(f"""WITH {TOKENS}, bx AS (SELECT l_suppkey % 40 AS item_id, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey AS box
  FROM lineitem WHERE l_suppkey % 40 IN (SELECT item_id FROM benchmark))
SELECT item_id, pos, coalesce(token, 'MISS') AS token, box, box IS NULL AS excluded FROM tok FULL JOIN bx USING (item_id, pos)""")
def align_missing(spark, sf):
    """Whole items; the boxes of an item come from many orders, so that there are more of them than tokens."""
    tok = _tokens(spark, sf)
    item = F.col("l_suppkey") % 40
    pos = F.row_number().over(Window.partitionBy(item).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    bx = load(spark, sf, "lineitem").select(item.alias("item_id"), pos.alias("pos"), F.col("l_partkey").alias("box"))
    return R.align_missing(tok, bx.join(load(spark, sf, "benchmark").select("item_id"), "item_id", "left_semi"), "item_id")


@query("""WITH s AS (SELECT d1.doc_id AS a, d2.doc_id AS b, d1.text AS x, CASE WHEN d1.doc_id % 2 = 0 THEN substr(d1.text, 2) || substr(d1.text, 1, 1) ELSE d2.text END AS y FROM documents d1 JOIN documents d2 ON d2.doc_id = d1.doc_id + 1)
SELECT a, b, list_sort(string_split(x, '')) = list_sort(string_split(y, '')) AS same FROM s""")
def multiset_equal(spark, sf):
    """Each whole text against itself, its first character moved to the end, or against the next text."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    e = d.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("z"))
    y = F.when(F.col("a") % 2 == 0, F.concat(F.expr("substring(x, 2)"), F.substring("x", 1, 1))).otherwise(F.col("z"))
    # texts of different lengths can't have the same signs
    same = F.when(F.length("x") != F.length("y"), False).otherwise(R.same_multiset(graphemes(F.col("x")), graphemes(F.col("y"))))
    return d.join(e, "a").withColumn("y", y).select("a", "b", same.alias("same"))


@query("""WITH l AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 2 = 0),
r AS (SELECT event_id AS other, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT event_id, other FROM l LEFT JOIN r USING (user_id, event_type, k)""")
def dup_safe_mapping(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    left, right = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select(F.col("event_id").alias("other"), "user_id", "event_type", F.col("ts").alias("ts2"))
    return R.match_once(left, right, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], [F.col("ts2"), F.col("other")]).select("event_id", "other")


@query("""WITH o AS (SELECT user_id AS g, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 60 + 1 END AS ord FROM events),
g AS (SELECT g, count(*) AS n, count_if(ord IS NULL) AS n_unassigned, list_sort(list(DISTINCT ord) FILTER (ord IS NOT NULL)) AS have FROM o GROUP BY 1),
r AS (SELECT g, count(*) AS n_repeated FROM (SELECT g, ord FROM o WHERE ord IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT g, n, n_unassigned, array_to_string(list_filter(range(1, n + 1), lambda x: NOT list_contains(have, x)), ',') AS missing, coalesce(n_repeated, 0) AS n_repeated FROM g LEFT JOIN r USING (g)""")
def order_gaps(spark, sf):
    e = F.col("event_id")
    o = load(spark, sf, "events").select(F.col("user_id").alias("g"), F.when(e % 11 != 0, e % 60 + 1).alias("ord"))
    return R.order_problems(o, "g", "ord").withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


@query("WITH d AS (SELECT DISTINCT user_id AS g, event_id // 40 AS v FROM events), r AS (SELECT *, v - row_number() OVER (PARTITION BY g ORDER BY v) AS k FROM d) SELECT g, min(v) AS first, max(v) AS last, count(*) AS length FROM r GROUP BY g, k")
def islands(spark, sf):
    return R.islands(load(spark, sf, "events").select(F.col("user_id").alias("g"), F.floor(F.col("event_id") / 40).alias("v")), "g", "v")


@query("""WITH e AS (SELECT event_id, user_id AS g, event_id % 3 = 0 AS sel, event_id % 25 + 1 AS cur FROM events),
n AS (SELECT *, CASE WHEN sel THEN 5 + row_number() OVER (PARTITION BY g, sel ORDER BY event_id) - 1 END AS new_order FROM e)
SELECT event_id, new_order, EXISTS (SELECT 1 FROM e WHERE e.g = n.g AND NOT e.sel AND e.cur = n.new_order) AS conflict FROM n""")
def range_assignment(spark, sf):
    e = F.col("event_id")
    d = load(spark, sf, "events").select("event_id", F.col("user_id").alias("g"), (e % 3 == 0).alias("sel"), (e % 25 + 1).alias("cur"), F.lit(5).alias("start"))
    return R.assign_range(d, "g", "sel", [e], "start", "cur").select("event_id", "new_order", "conflict")


# ---------------------------------------------------------------- glyphs


@query("""WITH r AS (SELECT vec_id AS codepoint, embedding AS v, label, vec_id // 2 % 50 AS sig FROM embeddings WHERE vec_id % 2 = 0), q AS (SELECT vec_id AS id, embedding AS v, label, vec_id // 2 % 100 AS sig FROM embeddings WHERE vec_id % 2 = 1),
x AS (SELECT id, min(codepoint) AS codepoint FROM q JOIN r USING (label, sig) GROUP BY 1),
p AS (SELECT id, codepoint, list_sum(list_transform(range(1, len(r.v) + 1), lambda i: abs(q.v[i]::DOUBLE - r.v[i]::DOUBLE))) AS d FROM q JOIN r USING (label) WHERE id NOT IN (SELECT id FROM x)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, codepoint) AS rn FROM p)
SELECT id, codepoint::INT AS codepoint, 'nearest' AS method, round(d, 5) AS distance FROM b WHERE rn = 1 UNION ALL SELECT id, codepoint::INT, 'exact', 0.0 FROM x""")
def exact_then_nearest(spark, sf):
    """Rows with an even id are references, those with an odd one are asked; some signatures coincide."""
    v = F.col("vec_id")
    e = load(spark, sf, "embeddings").select(v, F.col("label").alias("font"), F.col("embedding").alias("pixels"))
    sig = lambda n: (F.floor(v / 2) % n).cast("string").alias("signature")
    refs = e.where("vec_id % 2 = 0").select("font", sig(50), v.cast("int").alias("codepoint"), "pixels")
    ask = e.where("vec_id % 2 = 1").select(v.alias("id"), "font", sig(100), "pixels")
    return Y.match_glyphs(ask, refs).withColumn("distance", F.round("distance", 5))


@query("SELECT l_suppkey % 50 AS glyph, min(l_partkey) AS codepoint FROM lineitem GROUP BY 1")
def lowest_code(spark, sf):
    return Y.lowest_code(load(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("glyph"), F.col("l_partkey").alias("codepoint")))


@query("""WITH g AS (SELECT l_partkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE '' END AS f FROM lineitem), pr AS (SELECT p_partkey AS s FROM part WHERE p_partkey % 3 = 0)
SELECT count(*) AS total, count_if(pr.s IS NOT NULL) AS matched, count_if(pr.s IS NULL AND f <> '') AS fallback, count_if(pr.s IS NULL AND f = '') AS unresolved FROM g LEFT JOIN pr USING (s)""")
def decode_statistics(spark, sf):
    g = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("signature"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("").alias("fallback"))
    p = load(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("signature"), F.lit("a").alias("char"))
    return Y.decode_statistics(Y.decode(g, p))


# ---------------------------------------------------------------- constraints

FLAGGED = """f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'damaged' ELSE 'intact' END AS status, CASE WHEN event_id % 4 = 0 THEN (event_id % 5)::INT END AS damage_level,
  event_id % 6 = 0 AS unknown, event_id % 7 = 0 AS unavailable_font, event_id % 11 = 0 AS expert_prediction, event_id % 13 = 0 AS suspicious FROM events)"""


def _flagged(spark, sf):
    e = F.col("event_id")
    return load(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, "damaged").otherwise("intact").alias("status"), F.when(e % 4 == 0, (e % 5).cast("int")).alias("damage_level"),
        (e % 6 == 0).alias("unknown"), (e % 7 == 0).alias("unavailable_font"), (e % 11 == 0).alias("expert_prediction"), (e % 13 == 0).alias("suspicious"),
    )


@query(f"""WITH {FLAGGED} SELECT event_id, 'damage_level' AS rule FROM f WHERE damage_level IS NOT NULL AND NOT (damage_level BETWEEN 1 AND 3 AND status = 'damaged') UNION ALL
SELECT event_id, 'flags' FROM f WHERE unknown AND (status <> 'damaged' OR unavailable_font OR expert_prediction OR suspicious)""")
def flag_violations(spark, sf):
    s = F.col("status")
    return V.violations(_flagged(spark, sf), ["event_id"], {"damage_level": V.level_ok(s, F.col("damage_level")), "flags": V.flags_ok(s)})


@query(f"WITH {FLAGGED} SELECT event_id, status, CASE WHEN status = 'damaged' THEN damage_level END AS damage_level, unknown AND status = 'damaged' AS unknown, unavailable_font, expert_prediction, suspicious FROM f")
def flag_rules(spark, sf):
    return V.normalized_flags(_flagged(spark, sf))


@query(f"WITH {FLAGGED} SELECT event_id % 100 AS g, count(*) AS n_missing FROM f WHERE status = 'damaged' AND damage_level IS NULL GROUP BY 1")
def level_missing(spark, sf):
    return V.level_missing(_flagged(spark, sf).withColumn("g", F.col("event_id") % 100), "g")


@query("SELECT id, status FROM (SELECT c_nationkey AS id, CASE min(CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 3 END END) WHEN 1 THEN 'needs_review' WHEN 2 THEN 'extracted' WHEN 3 THEN 'planned' ELSE 'already_exists' END AS status FROM customer GROUP BY 1)")
def status_rollup(spark, sf):
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey")
    s = F.when(k == 0, "already_exists").when(k == 1, "extracted").when(k == 2, "planned").otherwise(F.when(n % 2 == 0, "needs_review").otherwise("planned"))
    return M.rollup(load(spark, sf, "customer").select(n.alias("id"), s.alias("status")))


@query("""WITH c AS (SELECT doc_id, length_grapheme(text) AS c, (n_chars - n_chars * (doc_id % 5 // 4) + doc_id % 2)::INT AS b FROM documents)
SELECT doc_id, b = c AND b > 0 AS bbox_valid, (b - c)::INT AS difference FROM c""")
def count_gate(spark, sf):
    """Graphemes of each whole text against a number of boxes that is its characters, one more, or next to none."""
    i, n = F.col("doc_id"), F.col("n_chars")
    boxes = (n - n * F.floor(i % 5 / 4) + i % 2).cast("int")
    d = load(spark, sf, "documents").select("doc_id", F.size(graphemes(F.col("text"))).alias("c"), boxes.alias("b"))
    return V.count_gate(d, "c", "b").select("doc_id", "bbox_valid", "difference")


@query("""WITH m AS (SELECT doc_id AS image, CASE doc_id % 3 WHEN 0 THEN 'missing_text' WHEN 1 THEN 'extra_text' ELSE 'other' END AS k, (doc_id % 6)::INT AS n, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE ' ' END AS note FROM documents)
SELECT image, 'direction' AS rule FROM m WHERE (k = 'missing_text' AND NOT n > 3) OR (k = 'extra_text' AND NOT n < 3) UNION ALL
SELECT image, 'padding' FROM m WHERE k = 'missing_text' AND n <> 3 UNION ALL
SELECT image, 'excluded' FROM m WHERE k = 'extra_text' AND NOT (n = 3) UNION ALL
SELECT image, 'note' FROM m WHERE k = 'other' AND trim(note) = ''""")
def mismatch_validate(spark, sf):
    i = F.col("doc_id")
    abc = F.array(*[F.lit(c) for c in "abc"])
    d = load(spark, sf, "documents").select(
        i.alias("image"), F.when(i % 3 == 0, "missing_text").when(i % 3 == 1, "extra_text").otherwise("other").alias("issue_type"), F.when(i % 4 == 0, "x").otherwise(" ").alias("note"),
        (i % 6).cast("int").alias("n_boxes"), abc.alias("characters"), abc.alias("sequence"), F.expr("cast(array() as array<string>)").alias("excluded"),
    )
    return V.mismatch_violations(d)


@query("""SELECT doc_id, doc_id % 2 = 0 AS gate_content, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS gate_boxes, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS gate_order,
doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS gate_status, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS gate_save FROM documents""")
def workflow_gates(spark, sf):
    i = F.col("doc_id")
    d = load(spark, sf, "documents").select(
        "doc_id", (i % 2 == 0).alias("text_ok"), F.lit(3).alias("n_chars"), F.when(i % 3 == 0, 4).otherwise(3).alias("n_boxes"), (i % 5 != 0).alias("order_ok"), (i % 7 != 0).alias("levels_ok"),
        F.lit(True).alias("sequence_ok"), (i % 11 != 0).alias("crop_ok"), F.lit(None).cast("string").alias("mismatch"), F.lit(False).alias("mismatch_text_same"),
    )
    return V.gates(d).select("doc_id", "gate_content", "gate_boxes", "gate_order", "gate_status", "gate_save")


@query("""WITH t AS (SELECT lang AS file, count(*) AS faces FROM documents GROUP BY 1), e AS (SELECT lang AS file, count(*) AS n FROM (SELECT lang, source FROM documents GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT file, faces, coalesce(n, 0) AS errors, CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t LEFT JOIN e USING (file)""")
def qa_report(spark, sf):
    return V.qa_report(load(spark, sf, "documents").select(F.col("lang").alias("file"), F.col("source").alias("face_key")), None)


@query("SELECT doc_id AS image, CASE WHEN quality IS NOT NULL THEN 'Done' ELSE 'Not Done' END AS status FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(lower(source), 'src1')")
def history_filter(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("image"), "source")
    return N.history(d, load(spark, sf, "labels").select(F.col("doc_id").alias("image"))).where(F.contains(F.lower("source"), F.lit("src1"))).select("image", "status")


@query("SELECT user_id AS image, arg_max(CASE WHEN event_id % 3 = 0 THEN 'mismatch' ELSE 'normal' END, event_id) AS kind, max(event_id) AS seq FROM events GROUP BY 1")
def exclusive_save(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("seq"))
    return N.exclusive(e.where("seq % 3 <> 0"), e.where("seq % 3 = 0"))


@query("SELECT conv_id, coalesce(max(text) FILTER (role = 'user' AND n = 1), '') AS user_text, coalesce(max(text) FILTER (role = 'system' AND n = 1), '') AS system_text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations) GROUP BY 1")
def content_map(spark, sf):
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("s"))
    m = c.withColumn("m", N.content_map(F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))), ["user", "system"]))
    return m.select("conv_id", F.element_at("m", "user").alias("user_text"), F.element_at("m", "system").alias("system_text"))


@query()
def nms_greedy(spark, sf):
    b = _boxes(spark, sf).withColumn("cls", (F.col("idx") % 2).cast("int"))
    return B.nms(b, 0.2).select("image", "idx", "cls")


@query()
def reading_order_full(spark, sf):
    return reading.full_order(_boxes(spark, sf).drop("score")).select("image", "idx", "reading_pos")


# ---------------------------------------------------------------- points, rows

_QUAD = "q AS (SELECT image, idx, x1 AS ax, y1 AS ay, x2 AS kx, y1 + idx AS ky, x2 - idx AS cx, y2 AS cy, x1 + 2 AS dx, y2 + 3 AS dy FROM b)"


def _tri(a: str, b: str, c: str) -> str:
    return f"abs({a}x * ({b}y - {c}y) + {b}x * ({c}y - {a}y) + {c}x * ({a}y - {b}y)) / 2"


def _half(a: str, b: str, c: str) -> str:
    return f"abs({_tri(a, b, c)} - {_tri('p', b, c)} - {_tri(a, 'p', c)} - {_tri(a, b, 'p')}) < 1e-6"


@query(f"""WITH {BOXES}, {_QUAD}, p AS (SELECT image, idx AS pt, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM b)
SELECT image, pt, idx FROM p JOIN q USING (image) WHERE ({_half('a', 'k', 'c')}) OR ({_half('a', 'c', 'd')})""")
def points_in_quads(spark, sf):
    """Middles of boxes in slanted quadrangles made of the boxes of their image."""
    b = _boxes(spark, sf)
    x, y = G.Box.of().mid
    p = b.select("image", F.col("idx").alias("pt"), x.alias("x"), y.alias("y"))
    k = F.col("idx")
    corners = ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y1") + k), (F.col("x2") - k, F.col("y2")), (F.col("x1") + 2, F.col("y2") + 3))
    q = b.select("image", "idx", *[c.alias(f"q{n}{i}") for i, xy in enumerate(corners, 1) for n, c in zip("xy", xy, strict=True)])
    return B.points_in(p, q, "image").select("image", "pt", "idx")


_PX = "greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1) + 1, 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1) + 1, 0)"


@query(f"""WITH {BOXES}, {D} SELECT image, idx FROM d a WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.image = a.image
  AND ({_PX} / ({AREA_A} + {AREA_C} - {_PX}) > 0.5 OR {_PX} / least({AREA_A}, {AREA_C}) > 0.5))""")
def unseen_boxes(spark, sf):
    """Boxes of one detector that the other one hasn't found as well."""
    b = _boxes(spark, sf)
    return B.unseen(b.where("idx % 2 = 1"), b.where("idx % 2 = 0")).select("image", "idx")


@query("""WITH RECURSIVE c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, (event_id * 53 % 1000)::DOUBLE AS l, (event_id * 37 % 400)::DOUBLE AS t, (event_id * 37 % 400 + 8 + event_id % 40)::DOUBLE AS b FROM events),
f(user_id, n, rs, pl) AS (SELECT user_id, 0::BIGINT, []::STRUCT(t DOUBLE, b DOUBLE)[], []::BIGINT[] FROM c WHERE idx = 1
  UNION ALL SELECT user_id, n + 1, CASE WHEN hit IS NULL THEN list_append(rs, {'t': t, 'b': b}) ELSE list_transform(rs, lambda r, i: CASE WHEN i = hit THEN {'t': least(r.t, t), 'b': greatest(r.b, b)} ELSE r END) END, list_append(pl, coalesce(hit, len(rs) + 1))
  FROM (SELECT f.*, c.t, c.b, nullif(list_position(list_transform(rs, lambda r: abs(r.t - c.t) < greatest(8, (c.b - c.t) / 2)), true), 0) AS hit FROM f JOIN c ON c.user_id = f.user_id AND c.idx = f.n + 1)),
d AS (SELECT user_id, rs, pl FROM f WHERE n = (SELECT max(idx) FROM c WHERE c.user_id = f.user_id)),
p AS (SELECT user_id, unnest(range(1, len(pl) + 1)) AS idx, unnest(pl) AS pl, rs FROM d),
r AS (SELECT c.*, len(list_filter(rs, lambda o, j: o.t < rs[pl].t OR (o.t = rs[pl].t AND j <= pl))) AS ro FROM p JOIN c USING (user_id, idx))
SELECT user_id, idx, ro::INT AS "row", (row_number() OVER (PARTITION BY user_id, ro ORDER BY l, idx))::INT AS place FROM r""")
def anchored_rows(spark, sf):
    """Events of a user as chips on a page, grouped to rows in the order in which they came."""
    k = F.col("event_id")
    top = (k * 37 % 400).cast("double")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    chips = load(spark, sf, "events").select("user_id", idx.alias("idx"), (k * 53 % 1000).cast("double").alias("left"), top.alias("top"), (top + 8 + k % 40).alias("bottom"))
    return B.anchored_rows(chips, "user_id").select("user_id", "idx", "row", "place")
