"""Merkle manifest of a table: a digest tree per group, one over the groups, and a proof for every row.

The leaves are sorted by range and numbered, so a task holds runs of neighbours and every parent knows from
the size of its tree how many children it gets. A task keeps partial parents, each with the digests that came
by their place; the one that completes a parent emits it, and the parent goes up as the next arrival. What stays
incomplete at the ends of a task's range (a few nodes a level) is the frontier: it is shuffled by ever wider
regions until the roots are reached. Proofs go the other way: each run of children, joined to what its parent has
of the path, hands it down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Fixed value: consecutive nodes that have one parent.
ARITY = 16
#: Levels by which the region in which a frontier meets grows each round.
RISE = 3
#: Rows of one batch that a task emits.
EMIT = 4096

_NODES = "kind string, grp string, n long, level int, idx long, digest string, kids array<string>"
_OUT = pa.schema([("kind", pa.string()), ("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])


def framed(*columns: Column | str) -> Column:
    """The columns' values as one text: '-' for null, else the UTF-8 byte count, ':' and the value."""
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof, an array of (left, right) from the lowest run up, lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, run by run, from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def climb(arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes nodes (grp, n, level, idx, digest), n being the leaves of the tree; emits complete runs of
    children, roots, and at the end the frontier: the nodes whose parents lack others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, int, int, int], dict[int, str]] = {}
        out: list[tuple] = []
        widths: tuple[str | None, list[int]] = (None, [])
        for batch in batches:
            for grp, n, level, idx, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if widths[0] != grp:  # nodes of each level; they come sorted by group
                    w = [n]
                    while w[-1] > 1:
                        w.append(-(-w[-1] // arity))
                    widths = grp, w
                while level < len(widths[1]) - 1:
                    up = idx // arity
                    kids = partial.setdefault((grp, n, level, up), {})
                    kids[idx] = digest
                    if len(kids) < min(arity, widths[1][level] - up * arity):
                        break
                    del partial[grp, n, level, up]
                    run = [kids[i] for i in sorted(kids)]
                    out.append(("run", grp, n, level, up, None, run))
                    level, idx, digest = level + 1, up, hashlib.sha256("".join(run).encode()).hexdigest()
                else:
                    out.append(("root", grp, n, level, 0, digest, None))
                if len(out) >= EMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                    out = []
        for (grp, n, level, _), kids in partial.items():
            out += [("frontier", grp, n, level, i, d, None) for i, d in kids.items()]
        for i in range(0, len(out), EMIT):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[i : i + EMIT], strict=True), _OUT, strict=True)], schema=_OUT)

    return task


def number(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with idx, their place in their grp by ``order`` (a total order), and n, their number. A group may
    reach over many ranges: places are counted inside a range, and what stands before it is added."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = cut(rows.repartitionByRange(ranges, "grp", *order).sortWithinPartitions("grp", *order).withColumn("at", at).withColumn("part", F.shiftright("at", 33)))
    starts = placed.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("here"))
    by = Window.partitionBy("grp")
    before = F.coalesce(F.sum("here").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("grp", "part", (before - F.col("low")).alias("shift"), F.sum("here").over(by).alias("n"))
    return placed.join(starts, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def tree(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Of leaves (grp, n, idx, digest): the complete runs (grp, level, idx of the parent, kids) and the
    roots (grp, level, digest)."""
    nodes, done, reach = leaves.select("grp", "n", F.lit(0).alias("level"), "idx", "digest"), [], 0
    while True:
        out = cut(nodes.sortWithinPartitions("grp", "level", "idx").mapInArrow(climb(arity), _NODES))
        done.append(out.where("kind <> 'frontier'"))
        frontier = out.where("kind = 'frontier'").drop("kind", "kids")
        if frontier.isEmpty():
            break
        reach += RISE
        # below the reach, nodes of one region meet; above it those of one parent
        steps = F.greatest(F.lit(reach) - F.col("level"), F.lit(1))
        region = F.floor(F.col("idx") / F.pow(F.lit(float(arity)), steps))
        nodes = frontier.repartition("grp", region)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.where("kind = 'run'").select("grp", "level", "idx", "kids"), every.where("kind = 'root'").select("grp", "level", "digest")


def hand_down(leaves: DataFrame, runs: DataFrame, roots: DataFrame, arity: int) -> DataFrame:
    """leaves (grp, n, idx, ...) with path and the other columns of roots (grp, level, path, ...): to the path of
    the root, what each run on the way adds."""
    extra = [c for c in roots.columns if c not in ("grp", "level", "path")]
    height = roots.agg(F.max("level")).first()[0] or 0

    def step(pos: Column, kids: Column) -> Column:
        return F.struct(F.array_join(F.slice(kids, 1, pos), "").alias("left"), F.array_join(F.slice(kids, pos + 2, F.lit(arity)), "").alias("right"))

    above = None
    for level in range(height, 0, -1):
        here = roots.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", *extra)
        above = here if above is None else above.unionByName(here)
        above = runs.where(F.col("level") == level - 1).select("grp", "idx", "kids").join(above, ["grp", "idx"])
        if level > 1:
            above = above.select("grp", "idx", "path", "kids", *extra, F.posexplode("kids").alias("pos", "kid"))
            above = above.select("grp", (F.col("idx") * arity + F.col("pos")).alias("idx"), F.concat(F.array(step(F.col("pos"), F.col("kids"))), "path").alias("path"), *extra)
    single = leaves.where("n = 1").join(roots.drop("level"), "grp")
    if above is None:
        return single
    pos = (F.col("idx") % arity).cast("int")
    many = leaves.where("n > 1").withColumn("up", F.floor(F.col("idx") / arity)).join(above.withColumnRenamed("idx", "up"), ["grp", "up"])
    many = many.withColumn("path", F.concat(F.array(step(pos, F.col("kids"))), "path")).drop("up", "kids")
    return many.unionByName(single)


def manifest(docs: DataFrame, fields: Sequence[str], group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, and the columns of ``carry``) of every row.

    A leaf is the SHA-256, in hex, of the row's framed ``fields``. Per group the leaves stand by key; every ``arity``
    consecutive nodes become the digest of their joined digests until one is left, the subroot. Subroots, ordered by
    group (null first, UTF-8 order), become the root likewise. proof is the array of (left, right) siblings from the leaf to
    the root. A null group is a group, a null key comes first, and rows of one key are ordered by leaf, equal ones
    arbitrarily (their digests agree). A lone leaf is its own subroot, with no siblings below it. Other columns
    are ignored; an empty table gives no rows."""
    carry = carry or {}
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")
    # digests only from here on; the row's number splits any pile of equal rows
    base = docs.select(grp, F.col(key).alias("key"), F.sha2(framed(*fields), 256).alias("digest"), *[c.alias(f"carry_{i}") for i, c in enumerate(carry.values())], F.monotonically_increasing_id().alias("uid"))
    leaves = number(cut(base), ["key", "digest", "uid"])
    runs, roots = tree(leaves, arity)
    subs = number(roots.select(F.lit("").alias("grp"), F.col("grp").alias("sub"), "digest", F.col("level").alias("sub_level")), ["sub"])
    top_runs, top = tree(subs, arity)
    tops = top.select("grp", "level", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    subs = cut(hand_down(subs, top_runs, tops, arity).select(F.col("sub").alias("grp"), F.col("sub_level").alias("level"), "path", "root", F.col("digest").alias("subroot")))
    out = hand_down(leaves, runs, subs, arity)
    name = F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group)
    return out.select(F.col("key").alias(key), name, F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
