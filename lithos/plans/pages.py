"""Queries over pages: runs of text operators, fonts, faces of volumes and their pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import analytics as A
from ..operators import boxes as B
from ..operators import display as D
from ..operators import missing as M
from ..operators import relational as R
from ..operators import validate as V
from .corpus import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- runs of glyphs

#: A page is a part. Runs (text, place, font): the second and third share a baseline within the tolerance, the third is a piece of the first.
_RUNS = ((1, "p_name", 10.0, 100.0, "f1"), (2, "p_type || p_brand", 60.0, 100.01, "f2"), (3, "substr(p_name, 4)", 30.0, 100.0, "f3"), (4, "p_brand || p_name", 10.0, 140.0, "f1"))
#: Spans (text, place): beginnings of runs, and pieces of them that no text matrix begins; one lies off all baselines.
_SPANS = (
    (1, "substr(p_name, 1, 6)", 10.0, 100.0), (2, "substr(p_name, 7)", 52.004, 100.0), (3, "p_brand", 130.0, 100.015), (4, "p_name || p_brand", 10.0, 140.0),
    (5, "substr(p_name, 3) || p_type", 30.0, 99.99), (6, "p_type", 60.0, 120.0),
)
_STEP = 10.0


def _texts(rows) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS page, {row[0]} AS id, {row[1]} AS t, {row[2]}::DOUBLE AS x, {row[3]}::DOUBLE AS y, {repr(row[4]) if len(row) > 4 else 'NULL'} AS font FROM part" for row in rows)


@query(f"""WITH RECURSIVE r AS ({_texts(_RUNS)}), s AS ({_texts(_SPANS)}),
c AS (SELECT page, id, t, y, i - 1 AS pos, substr(t, i) AS rest, x + {_STEP} * (i - 1) AS cx FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM s)),
o AS (SELECT page, id, font, x, y, off, substr(t, off + 1) AS rest FROM (SELECT *, unnest(range(0, length(t))) AS off FROM r)),
m AS (SELECT c.page, c.id, c.pos, c.cx, o.id AS run, o.font, o.x AS rx, c.y AS cy, o.y AS ry, off, (SELECT max(k) FROM range(1, length(c.rest) + 1) g(k) WHERE starts_with(o.rest, substr(c.rest, 1, k))) AS n
  FROM c JOIN o ON c.page = o.page AND abs(c.y - o.y) <= 0.02 AND substr(c.rest, 1, 1) = substr(o.rest, 1, 1)),
a AS (SELECT page, id, pos, arg_max(n, n * 10 - run) AS n, arg_max(font, n * 10 - run) AS font FROM m WHERE off = 0 AND round(cx, 2) = round(rx, 2) AND round(cy, 2) = round(ry, 2) GROUP BY 1, 2, 3),
l AS (SELECT page, id, pos, max(n) AS n FROM m GROUP BY 1, 2, 3),
b AS (SELECT page, id, pos, l.n, min(font) AS font FROM l JOIN m USING (page, id, pos) WHERE m.n = l.n GROUP BY 1, 2, 3, 4 HAVING min(font) = max(font)),
f(page, id, step, have) AS (SELECT page, id, 0, list_transform(range(length(t)), lambda j: NULL::VARCHAR) FROM s
  UNION ALL SELECT f.page, f.id, step + 1, CASE WHEN step < len(have) AND a.n IS NOT NULL THEN list_transform(have, lambda v, j: CASE WHEN j - 1 >= step AND j - 1 < step + a.n THEN a.font ELSE v END)
    WHEN step >= len(have) AND b.n IS NOT NULL AND have[step - len(have) + 1] IS NULL THEN list_transform(have, lambda v, j: CASE WHEN j - 1 >= step - len(have) AND j - 1 < step - len(have) + b.n THEN b.font ELSE v END) ELSE have END
  FROM f LEFT JOIN a ON a.page = f.page AND a.id = f.id AND a.pos = f.step AND f.step < len(f.have) LEFT JOIN b ON b.page = f.page AND b.id = f.id AND b.pos = f.step - len(f.have) WHERE step < 2 * len(have))
SELECT page, id AS span, (unnest(range(len(have))))::INT AS pos, unnest(have) AS font FROM f WHERE step = 2 * len(have)""")
def glyph_runs(spark, sf):
    """The font of every character of spans that begin anywhere in a run, among three fonts of one name."""
    part = load(spark, sf, "part")

    def texts(rows) -> DataFrame:
        made = [F.struct(F.lit(r[0]).alias("id"), F.expr(r[1]).alias("t"), F.lit(r[2]).alias("x"), F.lit(r[3]).alias("y"), F.lit(r[4] if len(r) > 4 else None).cast("string").alias("font")) for r in rows]
        return part.select(F.col("p_partkey").alias("page"), F.lit("n").alias("name"), F.explode(F.array(*made)).alias("r")).select("page", "name", "r.*")

    code = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: F.ascii(c))
    runs = texts(_RUNS).withColumn("codes", code).withColumnRenamed("id", "run")
    spans = texts(_SPANS).select("page", "name", F.col("id").alias("span"), F.posexplode(code).alias("pos", "code"), (F.col("x") + _STEP * F.col("pos")).alias("x"), "y")
    return D.assign_fonts(spans, runs, runs.select("page", "name", "font")).select("page", "span", "pos", "font")


#: Content of a page: an array of two groups, a run of half a code, a plain run, and one of a font that isn't listed.
_STREAM = "'q 1 0 0 1 ' || p_size || '.5 ' || p_partkey % 90 || '. Tm' || chr(10) || '/F' || p_partkey % 3 || ' 9 Tf [<00' || 41 + p_partkey % 8 || '>-20 <0042 0043>] TJ 1 0 0 1 5 7 Tm /F1 9 Tf <004> Tj -1 0 0 1 .5 -7 Tm /F' || p_partkey % 4 || ' 8.5 Tf <0' || p_partkey % 10 || '44> Tj'"


@query(f"""WITH s AS (SELECT p_partkey AS page, {_STREAM} AS c FROM part),
n AS (SELECT page, '([+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+))' AS num, c FROM s),
r AS (SELECT page, unnest(regexp_extract_all(c, '(?s)' || num || '\\s+' || num || '\\s+Tm\\s+/([^\\s/]+)\\s+[0-9.]+\\s+Tf\\s+(\\[.*?\\]\\s*TJ|<[0-9A-Fa-f\\s]+>\\s*Tj)')) AS m, num FROM n),
g AS (SELECT page, regexp_extract(m, num || '\\s+' || num || '\\s+Tm', 1)::DOUBLE AS x, regexp_extract(m, num || '\\s+' || num || '\\s+Tm', 2)::DOUBLE AS y, regexp_extract(m, '/([^\\s/]+)', 1) AS res,
  regexp_replace(array_to_string(regexp_extract_all(regexp_extract(m, '(?s)Tf(.*)', 1), '<([^>]*)>', 1), ''), '\\s', '', 'g') AS h FROM r)
SELECT page, x, y, 'Base' AS name, res AS font, array_to_string(list_transform(range(len(h) // 4), lambda i: (('0x' || h[i * 4 + 1:i * 4 + 4])::INT)::VARCHAR), ',') AS codes FROM g WHERE len(h) > 0 AND len(h) % 4 = 0 AND res IN ('F0', 'F1', 'F2')""")
def stream_runs(spark, sf):
    """Runs of the text operators of made-up page contents, for the three listed fonts of each page."""
    part = load(spark, sf, "part")
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    content = F.concat(
        F.lit("q 1 0 0 1 "), text(F.col("p_size")), F.lit(".5 "), text(k % 90), F.lit(". Tm\n/F"), text(k % 3), F.lit(" 9 Tf [<00"), text(41 + k % 8), F.lit(">-20 <0042 0043>] TJ 1 0 0 1 5 7 Tm /F1 9 Tf <004> Tj -1 0 0 1 .5 -7 Tm /F"),
        text(k % 4), F.lit(" 8.5 Tf <0"), text(k % 10), F.lit("44> Tj"),
    )
    fonts = part.select(k.alias("page"), F.explode(F.array(*[F.lit(f"F{i}") for i in range(3)])).alias("resource")).select("page", "resource", F.lit("Base").alias("name"), F.col("resource").alias("font"))
    runs = D.font_runs(part.select(k.alias("page"), content.alias("content")), fonts)
    return runs.select("page", "x", "y", "name", "font", F.array_join(F.transform("codes", text), ",").alias("codes"))


@query("""WITH b AS (SELECT p_partkey % 40 AS page, 'ABCDEF+' || p_name || (CASE WHEN p_partkey % 3 = 0 THEN '-Bold' ELSE '' END) AS base FROM part GROUP BY ALL), f AS (SELECT p_partkey % 40 AS page, upper(p_name) || (CASE WHEN p_partkey % 5 = 0 THEN ' Bold MT' ELSE '' END) AS font FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
k AS (SELECT b.page, base, font, regexp_replace(lower(substr(base, 8)), '[^\\p{L}\\p{N}]', '', 'g') AS x, regexp_replace(lower(font), '[^\\p{L}\\p{N}]', '', 'g') AS y FROM b LEFT JOIN f USING (page)),
m AS (SELECT *, CASE WHEN x = y THEN 1000000 WHEN starts_with(x, y) OR starts_with(y, x) THEN least(length(x), length(y)) END AS s FROM k),
t AS (SELECT page, base, max(s) AS s FROM m GROUP BY 1, 2)
SELECT page, base, CASE WHEN count(DISTINCT font) = 1 THEN min(font) END AS font FROM t LEFT JOIN m USING (page, base, s) GROUP BY 1, 2""")
def page_fonts(spark, sf):
    """The font of a page that a base name of it means."""
    k, part = F.col("p_partkey"), load(spark, sf, "part")
    bases = part.select((k % 40).alias("page"), F.concat(F.lit("ABCDEF+"), "p_name", F.when(k % 3 == 0, "-Bold").otherwise("")).alias("base")).distinct()
    fonts = part.where(k % 2 == 0).select((k % 40).alias("page"), F.concat(F.upper("p_name"), F.when(k % 5 == 0, " Bold MT").otherwise("")).alias("font")).distinct()
    return D.font_of_page(bases, fonts)


# ---------------------------------------------------------------- pictures of a volume

_IMG = """i AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, l_partkey % 2 AS s, (l_partkey % 2 * 200 + l_suppkey % 3 * 0.75)::DOUBLE AS x1, l_partkey % 2 * 200 + 180 + l_suppkey % 3 * 0.75::DOUBLE AS x2,
  2 + l_suppkey % 9 * 0.015625::DOUBLE AS scale FROM lineitem),
c AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY idx * 50 - s * 50 - idx % 3 * 0.5, x1, idx) AS n, x1, (idx * 50 - s * 50 - idx % 3 * 0.5)::DOUBLE AS y1, x2, (idx * 50 + 50 - s * 50)::DOUBLE AS y2, scale FROM i)"""


@query(f"""WITH RECURSIVE {_IMG},
f(page, k, g) AS (SELECT page, 0::BIGINT, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, scale DOUBLE, n INT)[] FROM c WHERE n = 1
  UNION ALL SELECT page, k + 1, CASE WHEN len(list_filter(hit, lambda h: h)) = 1
    THEN list_transform(g, lambda o, j: CASE WHEN hit[j] THEN {{'x1': least(o.x1, x1), 'y1': least(o.y1, y1), 'x2': greatest(o.x2, x2), 'y2': greatest(o.y2, y2), 'scale': greatest(o.scale, scale), 'n': o.n + 1}} ELSE o END)
    ELSE list_append(g, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'scale': scale, 'n': 1}}) END
  FROM (SELECT f.*, c.* EXCLUDE (page, n), list_transform(g, lambda o: abs(o.x1 - c.x1) <= 1 AND abs(o.x2 - c.x2) <= 1 AND abs(o.y2 - c.y1) <= 1 AND abs(o.scale - c.scale) <= 0.03 * c.scale) AS hit FROM f JOIN c ON c.page = f.page AND c.n = f.k + 1)),
d AS (SELECT page, unnest(g) AS o FROM f WHERE k = (SELECT max(n) FROM c WHERE c.page = f.page)) SELECT page, o.x1 AS x1, o.y1 AS y1, o.x2 AS x2, o.y2 AS y2, o.scale AS scale, o.n AS n FROM d""")
def face_strips(spark, sf):
    """Strips in two stacks a page, some a little off, as pictures."""
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    stack, off = F.col("l_partkey") % 2, F.col("l_suppkey") % 3 * 0.75
    i = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), idx.alias("idx"), (stack * 200 + off).cast("double").alias("x1"), (stack * 200 + 180 + off).cast("double").alias("x2"), stack.alias("s"), (2 + F.col("l_suppkey") % 9 * 0.015625).alias("scale"))
    y1, y2 = F.col("idx") * 50 - F.col("s") * 50 - F.col("idx") % 3 * 0.5, F.col("idx") * 50 + 50 - F.col("s") * 50
    return B.strips(i.withColumn("y1", y1.cast("double")).withColumn("y2", y2.cast("double")))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
r AS (SELECT '00' || k AS id FROM c UNION ALL SELECT ' ' || n FROM c UNION ALL SELECT '' FROM c UNION ALL SELECT 'A0' || k % 50 FROM c UNION ALL SELECT (k * 3)::VARCHAR || ' ' FROM c),
z AS (SELECT DISTINCT CASE WHEN regexp_full_match(trim(id), '[0-9]+') THEN (trim(id)::HUGEINT)::VARCHAR ELSE trim(id) END AS id FROM r WHERE trim(id) <> '')
SELECT id, id IN (SELECT o_custkey::VARCHAR FROM orders) AS found FROM z""")
def requested_ids(spark, sf):
    """Ids that a report names, at its top and in its groups, and whether the volumes have them."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    groups = F.array(F.struct(F.array(F.lit(""), F.concat(F.lit("A0"), s(k % 50))).alias("missing_ids")), F.struct(F.array(F.concat(s(k * 3), F.lit(" "))).alias("missing_ids")))
    report = load(spark, sf, "customer").select(F.array(F.concat(F.lit("00"), s(k)), F.concat(F.lit(" "), s(F.col("c_nationkey")))).alias("missing_ids"), groups.alias("groups"))
    wanted = M.requested(report)
    there = wanted.intersect(load(spark, sf, "orders").select(s(F.col("o_custkey")).alias("id")))
    return wanted.join(there.withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


#: Lines of a record by its key modulo 5, and the ids that they name.
_LINES = {0: ("{k} / 0{k}1", "99"), 1: ("", "   ", "7, {k}", "9"), 2: ("5 /", "{k}–2 ;", " 004.", "8"), 3: ("3, ", "{k}; x", "1"), 4: ("{k},{k}", "2")}
_IDS = {0: ("{k}", "{k}1"), 1: ("7", "{k}"), 2: ("5", "{k}", "2", "4"), 3: ("3",), 4: ("{k}", "{k}")}


def _case(of: dict, item) -> str:
    return "CASE k % 5 " + " ".join(f"WHEN {n} THEN [{', '.join(item(t) for t in parts)}]" for n, parts in of.items()) + " END"


def _sql_text(t: str) -> str:
    return "('" + t.replace("{k}", "' || k || '") + "')::HUGEINT::VARCHAR"


@query(f"""WITH o AS (SELECT o_orderkey AS k, 'V' || o_custkey % 20 AS volume, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rec FROM orders)
SELECT volume, rec, array_to_string({_case(_IDS, _sql_text)}, ',') AS ids, rec * 1000000::BIGINT + 1000 AS "start", CASE WHEN rec = max(rec) OVER (PARTITION BY volume) THEN 100001 * 1000000::BIGINT ELSE (rec + 1) * 1000000::BIGINT + 1000 END AS "end" FROM o""")
def inscription_ids(spark, sf):
    """Ids and places of records, from the lines of volumes; ids go on in lines of digits while the value is open."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(k.alias("k"), F.concat(F.lit("V"), (F.col("o_custkey") % 20).cast("string")).alias("volume"), F.lit(1).alias("one"))
    o = R.running_sum(o, "volume", "k", "one").withColumnRenamed("so_far", "page_number")
    text = lambda t: F.concat(*[x for i, part in enumerate(t.split("{k}")) for x in ((F.col("k").cast("string"),) if i else ()) + ((F.lit(part),) if part else ())] or [F.lit("")])
    own = F.array()
    for n, parts in _LINES.items():
        own = F.when(F.col("k") % 5 == n, F.array(F.concat(F.lit("Ids: "), text(parts[0])), *[text(t) for t in parts[1:]])).otherwise(own.cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("BIA "), F.col("k").cast("string")), F.lit("12 / 13")), own, F.array(F.lit("end"), F.lit("Ids: 1000")))
    rows = o.select("volume", "page_number", F.posexplode(lines).alias("n", "text"))
    rows = rows.select("volume", "page_number", (F.col("page_number").cast("long") * 100 + F.col("n")).alias("line_no"), (10.0 + F.col("n")).alias("y0"), "text")
    got = M.inscriptions(rows, "^BIA [0-9]+$", "^Ids: ", 100_000)
    return got.select("volume", "rec", F.array_join("ids", ",").alias("ids"), "start", "end")


_PLAN = """o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS volume, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) AS rec FROM orders),
n AS (SELECT volume, rec, unnest(CASE WHEN k % 7 = 0 THEN [k, k] WHEN k % 11 = 0 THEN [k, k + 22] ELSE [k, k + 10000000] END)::VARCHAR AS id, generate_subscripts([1, 2], 1) AS pos, k % 7 > 0 AS differ FROM o),
p AS (SELECT volume, rec, row_number() OVER (PARTITION BY volume, rec ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, rec AS page, l_linenumber::INT AS idx FROM lineitem JOIN o ON k = l_orderkey WHERE l_linenumber <= 3 AND l_quantity < 40),
c AS (SELECT volume, rec, count(*) AS m FROM p GROUP BY 1, 2),
w AS (SELECT DISTINCT (k + (k % 3) * 5000000)::VARCHAR AS id FROM o),
a AS (SELECT w.id, count(DISTINCT n.volume * 1000000 + n.rec) AS hits, min(CASE WHEN differ AND m = 2 THEN 1 ELSE 0 END) AS exact, min(page) AS page, min(idx) AS idx FROM w LEFT JOIN n USING (id) LEFT JOIN c USING (volume, rec) LEFT JOIN p USING (volume, rec, pos) GROUP BY 1),
s AS (SELECT id, CASE WHEN id::BIGINT % 13 = 0 THEN 'planned' WHEN hits = 0 THEN 'not_found' WHEN hits = 1 AND exact = 1 THEN 'planned' ELSE 'needs_review' END AS status, CASE WHEN id::BIGINT % 13 = 0 THEN 5 ELSE page END AS page, CASE WHEN id::BIGINT % 13 = 0 THEN 1 ELSE idx END AS idx FROM a)"""


@query(f"""WITH {_PLAN} SELECT id, status, CASE WHEN status = 'planned' THEN page END AS page, CASE WHEN status = 'planned' THEN idx END AS idx, false AS unread FROM s
UNION ALL SELECT id, CASE WHEN status = 'planned' THEN 'needs_review' ELSE status END, NULL, NULL, true FROM s""")
def picture_plan(spark, sf):
    """Pictures for wanted ids, with overrides, once when all volumes were read and once when one was not."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(k.alias("k"), (k % 10).alias("volume"), F.row_number().over(Window.partitionBy(k % 10).orderBy(k)).alias("rec"))
    key = F.col("k")
    ids = F.when(key % 7 == 0, F.array(key, key)).when(key % 11 == 0, F.array(key, key + 22)).otherwise(F.array(key, key + 10_000_000))
    start = F.col("rec").cast("long") * M.PAGE
    records = o.select("volume", "rec", F.transform(ids, lambda i: i.cast("string")).alias("ids"), start.alias("start"), (start + M.PAGE).alias("end"))
    line = load(spark, sf, "lineitem").where("l_linenumber <= 3 AND l_quantity < 40").join(o, F.col("l_orderkey") == key)
    # ties of a line number are told apart by their height
    y = F.col("l_linenumber") * 100 + F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    pics = line.select("volume", F.col("l_linenumber").cast("int").alias("idx"), F.col("rec").alias("page"), y.cast("double").alias("y0"), (y + 9).cast("double").alias("y1"))
    wanted = o.select((key + key % 3 * 5_000_000).cast("string").alias("id"))
    over = wanted.distinct().where(F.col("id").cast("long") % 13 == 0).select("id", F.lit(5).alias("page"), F.lit(1).alias("idx"))
    none, some = spark.createDataFrame([], "error string"), load(spark, sf, "nation").select(F.col("n_name").alias("error"))
    both = [M.plan(wanted, records, pics, over, e).withColumn("unread", F.lit(u)) for e, u in ((none, False), (some, True))]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- orders and reports


@query("""WITH g AS (SELECT l_orderkey AS k, list(l_linenumber::INT) AS l FROM lineitem GROUP BY 1), o AS (SELECT k, l, CASE WHEN k % 5 = 0 THEN list_append(l[2:], l[2]) WHEN k % 7 = 0 THEN l[2:] ELSE list_reverse(l) END AS p FROM (SELECT k, list_sort(l) AS l FROM g))
SELECT k AS o_orderkey, list_sort(p) = l AS ok FROM o""")
def order_permutation(spark, sf):
    """Whether an order of boxes is a permutation of them: some lack one, some repeat another instead."""
    g = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("l"))
    k, l = F.col("o_orderkey"), F.col("l")  # noqa: E741
    rest = F.expr("slice(l, 2, greatest(size(l) - 1, 0))")
    p = F.when(k % 5 == 0, F.concat(rest, F.array(F.get(l, F.lit(1))))).when(k % 7 == 0, rest).otherwise(F.reverse(l))
    return g.select("o_orderkey", V.permutation_ok(p, l).alias("ok"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_id * 7 % 60 AS n FROM events), r AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM d),
i AS (SELECT user_id, min(n) AS a, CASE WHEN min(n) = max(n) THEN min(n)::VARCHAR ELSE min(n) || '–' || max(n) END AS t FROM r GROUP BY user_id, g), l AS (SELECT user_id, list(t ORDER BY a) AS p FROM i GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN len(p) > 4 THEN p[1:2] || ['…'] || p[-2:] ELSE p END, ', ') AS ranges FROM l""")
def conflict_ranges(spark, sf):
    return R.ranges_text(load(spark, sf, "events").select("user_id", (F.col("event_id") * 7 % 60).alias("n")), "user_id", "n")


@query("""WITH e AS (SELECT user_id % 12 AS volume, event_id % 40 AS n, event_id % 5 AS c FROM events), b AS (SELECT volume, nullif(n, 7) AS n, c = 1 AS lacks FROM e WHERE c IN (1, 2))
SELECT volume, count(*) FILTER (c = 0) + any_value(invalid) AS total, count(*) FILTER (c = 0) AS valid, any_value(invalid) AS invalid, any_value(i) AS invalid_numbers, any_value(l) AS missing_numbers, any_value(u) AS unassigned FROM e JOIN
(SELECT volume, count(DISTINCT n) AS invalid, array_to_string(list_sort(list(DISTINCT n) FILTER (n IS NOT NULL)), ',') AS i, coalesce(array_to_string(list_sort(list(DISTINCT n) FILTER (lacks AND n IS NOT NULL)), ','), '') AS l, count(*) FILTER (n IS NULL) AS u FROM b GROUP BY 1) USING (volume) GROUP BY 1""")
def extraction_report(spark, sf):
    """Of each volume the numbers with errors and those that lack a section; c = 3 has warnings only."""
    e = load(spark, sf, "events").select((F.col("user_id") % 12).alias("volume"), (F.col("event_id") % 40).alias("n"), (F.col("event_id") % 5).alias("c"))
    errors = F.when(F.col("c") == 1, F.array(F.lit("no face"), F.lit("lacks Text"))).when(F.col("c") == 2, F.array(F.lit("no face"))).otherwise(F.expr("cast(array() as array<string>)"))
    issues = e.where("c IN (1, 2, 3)").select("volume", F.nullif("n", F.lit(7)).alias("number"), errors.alias("errors"))
    out = A.extraction_report(e.where("c = 0"), issues, "lacks Text")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("volume", "total", "valid", "invalid", text("invalid_numbers"), text("missing_numbers"), "unassigned")


# ---------------------------------------------------------------- alignment

#: Orders as documents: their lines are boxes. By the key modulo 8 the alignment before is the same, in another order, of other signs, without ids, or of a text that
#: lacks signs or has too many.
_ALIGN = """b AS (SELECT l_orderkey AS k, l_orderkey % 8 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, chr((65 + l_suppkey % 6)::INT) AS sign FROM lineitem),
g AS (SELECT k, m, count(*) AS n, list(sign ORDER BY pos) AS signs FROM b GROUP BY 1, 2),
d AS (SELECT k, m, n, CASE m WHEN 4 THEN signs[:-2] WHEN 5 THEN signs || ['X', 'Y'] WHEN 6 THEN signs || ['X', 'Y'] WHEN 7 THEN signs || ['Z'] WHEN 2 THEN signs[2:] || ['Q'] ELSE signs END AS chars,
  CASE m WHEN 4 THEN 'missing_text' WHEN 5 THEN 'extra_text' WHEN 6 THEN 'extra_text' WHEN 7 THEN 'other' END AS kind, CASE WHEN m IN (5, 6) THEN ['X', 'Y'] ELSE []::VARCHAR[] END AS excluded, CASE m WHEN 5 THEN ['e1', 'e2'] ELSE []::VARCHAR[] END AS extra FROM g),
o AS (SELECT b.k, b.m, pos, CASE WHEN b.m = 1 THEN n + 1 - pos ELSE pos END AS was, CASE WHEN b.m = 4 AND pos = n THEN 'MISS' ELSE sign END AS token, CASE WHEN b.m = 3 AND pos = 1 THEN NULL ELSE 't' || pos END AS id FROM b JOIN g USING (k)),
h AS (SELECT k, count(*) FILTER (pos = was) AS same, count(id) AS ids, list(token) FILTER (token <> 'MISS') AS held FROM o GROUP BY 1),
s AS (SELECT d.*, same = n AND list_sort(coalesce(held, []::VARCHAR[]) || excluded) = list_sort(chars) AS keep, ids = n AND len(extra) = len(excluded) AS named FROM d JOIN h USING (k)),
r AS (SELECT k, pos, pos AS uid, CASE WHEN keep THEN token WHEN len(chars) = n OR kind = 'extra_text' THEN chars[pos] WHEN kind = 'missing_text' THEN coalesce(chars[pos], 'MISS') END AS token, CASE WHEN keep AND named THEN id ELSE pos::VARCHAR END AS id FROM s JOIN o USING (k)
  UNION ALL SELECT k, n + i, NULL, CASE WHEN keep THEN excluded[i] ELSE chars[n + i] END, CASE WHEN keep AND named THEN extra[i] ELSE (n + i)::VARCHAR END FROM (SELECT *, unnest(range(1, 3)) AS i FROM s WHERE kind = 'extra_text'))"""


def _lines_of(spark, sf) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), pos.alias("pos"), F.chr(65 + F.col("l_suppkey") % 6).alias("sign"))


@query(f"WITH {_ALIGN} SELECT k AS image, pos::INT AS pos, uid::INT AS uid, token, CASE WHEN token IS NOT NULL THEN id END AS token_id FROM r")
def kept_alignment(spark, sf):
    """What documents keep of their alignment when boxes, order or text have changed."""
    b = _lines_of(spark, sf)
    m = F.col("image") % 8
    docs = b.groupBy("image").agg(F.count("*").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]).alias("s"))
    more = lambda *t: F.concat("s", F.array(*[F.lit(x) for x in t]))
    chars = F.when(m == 4, F.slice("s", 1, F.greatest(F.col("n") - 1, F.lit(0)))).when(m.isin(5, 6), more("X", "Y")).when(m == 7, more("Z")).when(m == 2, F.concat(F.slice("s", 2, F.col("n")), F.array(F.lit("Q")))).otherwise(F.col("s"))
    kind = F.when(m == 4, "missing_text").when(m.isin(5, 6), "extra_text").when(m == 7, "other")
    left = F.when(m.isin(5, 6), F.array(F.lit("X"), F.lit("Y")))
    docs = docs.select("image", "n", chars.alias("chars"), kind.alias("kind"), left.alias("excluded"), F.when(m == 5, F.array(F.lit("e1"), F.lit("e2"))).alias("extra_ids"))
    old = b.join(docs.select("image", "n"), "image")
    token = F.when((m == 4) & (F.col("pos") == F.col("n")), "MISS").otherwise(F.col("sign"))
    name = F.when((m != 3) | (F.col("pos") != 1), F.concat(F.lit("t"), F.col("pos").cast("string")))
    old = old.select("image", F.col("pos").alias("uid"), F.when(m == 1, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), token.alias("token"), name.alias("token_id"))
    return L.realigned(docs, b.select("image", F.col("pos").alias("uid"), "pos"), old)


@query("""WITH b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, chr((65 + l_suppkey % 3)::INT) AS token FROM lineitem),
n AS (SELECT k, count(*) AS n FROM b GROUP BY 1), w AS (SELECT k, n + 1 - pos AS pos, CASE WHEN k % 5 = 0 AND pos = 1 THEN 'Q' ELSE token END AS token FROM b JOIN n USING (k) WHERE NOT (k % 7 = 0 AND pos = 1)),
c AS (SELECT *, row_number() OVER (PARTITION BY k, token ORDER BY pos) AS q FROM b), v AS (SELECT *, row_number() OVER (PARTITION BY k, token ORDER BY pos) AS q FROM w)
SELECT k AS image, v.pos::INT AS pos, token, 't' || c.pos AS token_id, true AS accepted FROM v JOIN c USING (k, token, q) WHERE k % 5 > 0 AND k % 7 > 0 UNION ALL SELECT k, pos::INT, token, 't' || pos, false FROM b WHERE k % 5 = 0 OR k % 7 = 0""")
def rearranged_tokens(spark, sf):
    """Signs in the opposite order, with their tokens; sequences that lack a sign or have another are refused."""
    b = _lines_of(spark, sf).withColumn("token", F.chr(65 + (F.ascii("sign") - 65) % 3)).drop("sign")
    k = F.col("image")
    n = b.groupBy("image").agg(F.count("*").cast("int").alias("n"))
    w = b.join(n, "image").where(~((k % 7 == 0) & (F.col("pos") == 1)))
    w = w.select("image", (F.col("n") + 1 - F.col("pos")).alias("pos"), F.when((k % 5 == 0) & (F.col("pos") == 1), "Q").otherwise(F.col("token")).alias("token"))
    return L.resequenced(b.withColumn("token_id", F.concat(F.lit("t"), F.col("pos").cast("string"))), w)


@query("""WITH b AS (SELECT event_id AS uid, user_id AS image, CASE WHEN event_id % 3 = 0 THEN 'intact' ELSE 'damaged' END AS status, CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 2 END AS lvl, event_id % 3 = 1 AND event_id % 4 = 0 AS u, event_id % 5 = 0 AND NOT (event_id % 3 = 1 AND event_id % 4 = 0) AS f, false AS e, event_id % 3 = 2 AND event_id % 7 = 0 AS s,
  CASE event_id % 11 WHEN 0 THEN '□' WHEN 1 THEN '@' WHEN 2 THEN 'MISS' ELSE 'x' END AS t FROM events),
p AS (SELECT *, CASE WHEN image % 17 = 3 AND uid % 9 = 0 THEN 'lost' WHEN uid % 2 = 0 THEN 'damaged' ELSE 'intact' END AS ns, CASE WHEN image % 17 = 5 AND uid % 8 = 0 THEN 4 WHEN uid % 4 = 0 THEN 3 END AS nl,
  CASE WHEN uid % 6 = 0 THEN true ELSE u END AS nu, CASE WHEN uid % 10 = 1 THEN true ELSE f END AS nf, CASE WHEN uid % 10 = 2 THEN true ELSE e END AS ne, CASE WHEN uid % 10 = 3 THEN false ELSE s END AS nx FROM b),
k AS (SELECT image, bool_and(ns <> 'lost' AND (nl IS NULL OR nl <= 3)) AND NOT (image % 17 = 7 AND count(*) FILTER (uid % 5 = 0) > 0) AND image % 17 <> 9 AS ok FROM p GROUP BY 1),
a AS (SELECT p.*, nu AND NOT u AS du, (nf AND NOT f) OR (ne AND NOT e) OR (nx AND NOT s) AS dx FROM p),
c AS (SELECT *, nu AND (du OR NOT dx) AS cu, nf AND NOT du AS cf, ne AND NOT du AS ce, nx AND NOT du AS cx, ns = 'damaged' OR t = '□' AS hurt FROM a)
SELECT image, uid, CASE WHEN NOT ok THEN status WHEN t = '□' THEN 'damaged' ELSE ns END AS status, CASE WHEN NOT ok THEN lvl WHEN hurt THEN nl END::INT AS damage_level, CASE WHEN NOT ok THEN u ELSE t = '□' OR (cu AND hurt AND t NOT IN ('@', 'MISS')) END AS unknown,
  CASE WHEN NOT ok THEN f ELSE (cf OR t = '@') AND t NOT IN ('□', 'MISS') END AS unavailable_font, CASE WHEN NOT ok THEN e ELSE ce AND t NOT IN ('□', 'MISS') END AS expert_prediction, CASE WHEN NOT ok THEN s ELSE cx AND t NOT IN ('□', 'MISS') END AS suspicious, ok AS accepted FROM c JOIN k USING (image)""")
def replaced_statuses(spark, sf):
    """Statuses of all boxes of a user, replaced as a whole; updates with an unknown status, a level of 4, a box too few or one twice are refused."""
    k, image = F.col("event_id"), F.col("user_id")
    b = load(spark, sf, "events").select(
        image.alias("image"), k.alias("uid"), F.when(k % 3 == 0, "intact").otherwise("damaged").alias("status"), F.when(k % 3 > 0, 1 + k % 2).cast("int").alias("damage_level"), ((k % 3 == 1) & (k % 4 == 0)).alias("unknown"),
        ((k % 5 == 0) & ~((k % 3 == 1) & (k % 4 == 0))).alias("unavailable_font"), F.lit(False).alias("expert_prediction"), ((k % 3 == 2) & (k % 7 == 0)).alias("suspicious"),
        F.when(k % 11 == 0, "□").when(k % 11 == 1, "@").when(k % 11 == 2, "MISS").otherwise("x").alias("token"),
    )
    i, u = F.col("image") % 17, F.col("uid")
    new = b.where(~((i == 7) & (u % 5 == 0))).select(
        "image", "uid", F.when((i == 3) & (u % 9 == 0), "lost").when(u % 2 == 0, "damaged").otherwise("intact").alias("status"), F.when((i == 5) & (u % 8 == 0), 4).when(u % 4 == 0, 3).cast("int").alias("damage_level"), F.when(u % 6 == 0, True).alias("unknown"),
        F.when(u % 10 == 1, True).alias("unavailable_font"), F.when(u % 10 == 2, True).alias("expert_prediction"), F.when(u % 10 == 3, False).alias("suspicious"),
    )
    new = new.unionByName(new.where(F.col("image") % 17 == 9))
    return L.replaced_statuses(b, new).drop("token")
