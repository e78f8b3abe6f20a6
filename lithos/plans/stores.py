"""Queries that write and read stores: split JSON arrays, cached sources, committed outputs, registries.

Each derives files from a whole table, in a new folder that all machines share, and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import arrays as A
from ..sources import commits as C
from ..sources.cache import RecordCache
from ..sources.registry import Registry
from ..sources.shared import shared_folder
from .corpus import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- arrays

#: Names of files that sort otherwise by case than without it, and texts with the signs that arrays are split at.
_FILE = "CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END"
_NOTE = "c_mktsegment || '\"}],{[' || '\\' || CASE WHEN c_custkey % 7 = 0 THEN 'é漢' ELSE '' END"


@query(f"""WITH d AS (SELECT {_FILE} AS name, c_custkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN {_NOTE} END AS note FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT name, (dense_rank() OVER (ORDER BY lower(name)) - 1)::INT AS file_order, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS "index", c_custkey, c_acctbal, note FROM d""")
def array_scan(spark, sf):
    """Customers written as one JSON array a nation, and read by tasks that take blocks of the files."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    name = F.when(n % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    note = F.concat("c_mktsegment", F.lit('"}],{[\\'), F.when(k % 7 == 0, "é漢").otherwise(""))
    d = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == n)
    d = d.select(name.alias("name"), "c_custkey", "c_acctbal", F.when(k % 5 > 0, note).alias("note"))
    at = shared_folder(spark, "arrays")
    A.write_arrays(d, at, "name", ["c_custkey"])
    rows = A.read_array(spark, at, "c_custkey long, c_acctbal double, note string")
    return rows.select(F.regexp_extract("file", "([^/]+)[.]json$", 1).alias("name"), "file_order", "index", "record.*")


# ---------------------------------------------------------------- cached source

#: The nation whose file changes between the two refreshes, and by how much its codes do.
_CHANGED, _BY = 7, 5_000_000_000


def _cache(spark, sf) -> tuple[RecordCache, int]:
    """Customers as records with one to three faces, one file a nation; and files parsed when one of them has changed."""
    at = shared_folder(spark, "source")
    k = F.col("c_custkey")

    def records(shift: int) -> DataFrame:
        faces = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct((k * 10 + i + shift).cast("string").alias("ky_hieu")))
        return load(spark, sf, "customer").select("c_nationkey", k.alias("so_van_bia"), faces.alias("noi_dung"))

    A.write_arrays(records(0), f"{at}/in", "c_nationkey", ["so_van_bia"])
    cache = RecordCache(spark, f"{at}/in", f"{at}/cache", "so_van_bia long, noi_dung array<struct<ky_hieu:string>>")
    cache.refresh()
    A.write_arrays(records(_BY).where(F.col("c_nationkey") == _CHANGED), f"{at}/in", "c_nationkey", ["so_van_bia"])
    return cache, len(cache.refresh().parsed)


_FACES = f"""r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
f AS (SELECT (c_custkey * 10 + face + CASE WHEN c_nationkey = {_CHANGED} THEN {_BY} ELSE 0 END)::VARCHAR AS code, c_nationkey::VARCHAR AS name, i, face FROM (SELECT *, unnest(range(0, c_custkey % 3 + 1)) AS face FROM r))"""


@query(f"""WITH {_FACES} SELECT code, name, i AS "index", face::INT AS face, CASE WHEN name = '{_CHANGED}' THEN 2 ELSE 1 END AS gen, (SELECT count(DISTINCT name) FROM f WHERE name = '{_CHANGED}')::INT AS parsed FROM f""")
def incremental_source(spark, sf):
    """The index after one file of many has changed: only that one was parsed again."""
    cache, parsed = _cache(spark, sf)
    return cache.index().select("code", F.regexp_extract("file", "([^/]+)[.]json$", 1).alias("name"), "index", "face", F.col("gen").cast("int").alias("gen"), F.lit(parsed).alias("parsed"))


@query(f"""WITH {_FACES}, q AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN '00' ELSE '' END) || (o_custkey * 10 + o_orderkey % 3) || (CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS code FROM orders),
m AS (SELECT q.o_orderkey, q.code, coalesce(a.code, b.code) AS matched, coalesce(a.name, b.name) AS name, coalesce(a.i, b.i) AS i, coalesce(a.face, b.face) AS face
  FROM q LEFT JOIN f a ON a.code = q.code LEFT JOIN f b ON regexp_full_match(q.code, '[0-9]+') AND b.code = try_cast(q.code AS HUGEINT)::VARCHAR)
SELECT o_orderkey, code, CASE WHEN matched IS NULL THEN 0 ELSE 1 END AS matches, name, i AS "index", face::INT AS face FROM m""")
def indexed_lookup(spark, sf):
    """Pictures of orders by their code, with leading zeros or none, in the index of the cached source."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 4 == 0, "00").otherwise(""), (F.col("o_custkey") * 10 + k % 3).cast("string"), F.when(k % 5 == 0, "x").otherwise(""), F.lit(".jpg"))
    found = _cache(spark, sf)[0].locate(load(spark, sf, "orders").select("o_orderkey", name.alias("image")))
    return found.select("o_orderkey", "code", "matches", F.regexp_extract("file", "([^/]+)[.]json$", 1).alias("name"), "index", "face")


# ---------------------------------------------------------------- commits


@query("""WITH s AS (SELECT o_orderkey AS key, o_orderstatus = 'F' AS odd, o_orderpriority AS body, o_orderkey % 3 = 0 AS again FROM orders),
w AS (SELECT 1 AS version, CASE WHEN odd THEN 'mismatch' ELSE 'annotation' END AS output, key, body FROM s UNION ALL SELECT 1, 'content', key, body || '!' FROM s
  UNION ALL SELECT 2, CASE WHEN odd <> again THEN 'mismatch' ELSE 'annotation' END, key, CASE WHEN again THEN body || ' again' ELSE body END FROM s
  UNION ALL SELECT 2, 'content', key, CASE WHEN again THEN body || ' again!' ELSE body || '!' END FROM s)
SELECT * FROM w""")
def committed_outputs(spark, sf):
    """Saved orders: a document of one of two kinds and its content, in one commit; a second one saves a third of them again as the
    other kind, which deletes the first. Both versions are read."""
    root = shared_folder(spark, "outputs")
    s = load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("odd"), F.col("o_orderpriority").alias("body"))
    one = lambda output, body, seq: F.struct(output.alias("output"), body.alias("body"), F.lit(seq).alias("seq"))
    kind = lambda odd: F.when(odd, "mismatch").otherwise("annotation")
    save = lambda df, rows: C.write_outputs(df.select("key", F.explode(F.array(*rows)).alias("r")).select("r.output", "key", "r.body", "r.seq"), root)
    odd, body, again = F.col("odd"), F.col("body"), F.concat("body", F.lit(" again"))
    first = save(s, [one(kind(odd), body, 1), one(F.lit("content"), F.concat(body, F.lit("!")), 1)])
    second = save(s.where(F.col("key") % 3 == 0), [one(kind(~odd), again, 2), one(kind(odd), F.lit(None).cast("string"), 2), one(F.lit("content"), F.concat(again, F.lit("!")), 2)])
    parts = []
    for n, version in ((1, first.number), (2, second.number)):
        for name in ("annotation", "mismatch", "content"):
            last = C.read_output(spark, root, name, version).groupBy("key").agg(F.max_by("body", "seq").alias("body")).where("body is not null")
            parts.append(last.select(F.lit(n).alias("version"), F.lit(name).alias("output"), "key", "body"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH b AS (SELECT *, event_id % 3 AS batch FROM events)
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq FROM b GROUP BY 1""")
def registry_batches(spark, sf):
    """The latest event of each user from three batches, of which the last comes twice, the second time altered, with a compaction before."""
    registry = Registry(spark, shared_folder(spark, "registry"), "user_id", ["event_id"], buckets=8)
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    for n in range(3):
        registry.upsert(e.where(F.col("event_id") % 3 == n), "events", n)
    registry.compact(3)
    registry.upsert(e.where(F.col("event_id") % 3 == 2).withColumn("event_type", F.lit("altered")), "events", 2)
    return registry.read().select("user_id", "event_id", "event_type", F.col("first_seq.event_id").alias("first_seq"))
