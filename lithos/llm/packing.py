"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths goes to the driver (bounded: lengths beyond EXACT share bins of
relative width 2^-FINE, each of which counts as its longest), where dynamic programming with a convex hull
finds the bucket bounds of least padding. They are optimal if no row is longer than EXACT; else padding
exceeds the optimum by less than 2^-FINE, a thousandth, of the tokens of those rows. Batches of a bucket hold as
many rows as the token budget allows at the bucket's length. A row's place in its bucket is its place in a small
hashed shard plus the shard's offset, so no bucket is ever in one task; repeats of a key go as counts.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Lengths up to EXACT have bins of their own; longer ones are rounded up to FINE significant bits.
EXACT, FINE = 1 << 15, 10
#: Rows that a shard of a bucket holds on average.
SHARD_ROWS = 2000


def word_count(text: Column) -> Column:
    """Words, as runs of characters other than space and \\t-\\r: tokens where no tokenizer is given."""
    trimmed = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", "")
    return F.when(text.isNull() | (F.length(trimmed) == 0), 0).otherwise(F.size(F.split(F.regexp_replace(trimmed, "[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+"))).cast("long")


def bin_of(n: Column) -> Column:
    """The least bin that holds length n; n itself up to EXACT."""
    bits = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") - FINE
    step = F.expr("1L").cast("long") * F.pow(F.lit(2.0), F.greatest(bits, F.lit(0))).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step).cast("long") * step)


def optimal_bounds(hist: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, of least padding: each length is padded to the next
    bound. hist: (length, rows), lengths distinct.

    best[j] = min over i < j of last[i] + length[j] * (rows[j] - rows[i]) - (tokens[j] - tokens[i]),
    which for fixed i is a line in length[j]; slopes fall and queries grow, so a deque holds the hull.
    """
    hist = sorted((x, c) for x, c in hist if c > 0)
    n = len(hist)
    if not n:
        return []
    rows, toks = [0], [0]
    for x, c in hist:
        rows.append(rows[-1] + c)
        toks.append(toks[-1] + x * c)
    size = [0] + [x for x, _ in hist]
    best = [size[j] * rows[j] - toks[j] for j in range(n + 1)]
    back: list[list[int]] = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, frm = [0] * (n + 1), [0] * (n + 1)
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, i
        for j in range(1, n + 1):
            i = j - 1
            m, b = -rows[i], best[i] + toks[i]
            while len(hull) > 1 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, b, i))
            x = size[j]
            while len(hull) > 1 and hull[0][0] * x + hull[0][1] >= hull[1][0] * x + hull[1][1]:
                hull.popleft()
            new[j] = hull[0][0] * x + hull[0][1] + x * rows[j] - toks[j]
            frm[j] = hull[0][2]
        back.append(frm)
        if new[n] >= best[n]:
            back.pop()
            break
        best = new
    out, j = [], n
    for frm in reversed(back):
        if j == 0:
            break
        out.append(size[j])
        j = frm[j]
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 12, budget: int = 16384, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, n_tokens, bucket, bound, batch, slot) of every row: bucket counts from 0, bound is the
    length that its rows are padded to, batch counts from 0 in its bucket, and rows * bound of a batch
    stays within ``budget`` (a row longer than the budget is a batch by itself). Every batch of a
    bucket but the last is full.

    A row without tokens (null, empty or blank text) is in no batch: bucket, bound, batch and slot are
    null. A length that equals a bound is in its bucket; rows of a bucket stand in hashed shards and there by
    key and length. Repeated rows are packed each. Other columns are ignored. An empty table gives an empty
    result.
    """
    n = F.coalesce(tokens if tokens is not None else word_count(F.col(text).cast("string")), F.lit(0)).cast("long")
    # key and length only: the texts are read once, and lengths are at hand for histogram and places
    base = cut(docs.select(F.col(key).alias("key"), n.alias("n_tokens")).groupBy("key", "n_tokens").agg(F.count("*").alias("c")))
    rows = base.where("n_tokens > 0").groupBy(bin_of(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.sum("c").alias("c"))
    hist = [(r.longest, r.c) for r in rows.collect()]
    bounds = optimal_bounds(hist, buckets)
    held = [0] * len(bounds)
    for x, c in hist:
        held[next(i for i, b in enumerate(bounds) if x <= b)] += c
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("copy")
    # blocks of at most SHARD_ROWS repeats: what of a hot key is in one task is small
    blocks = base.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / SHARD_ROWS)))).withColumn("c", F.least(F.lit(SHARD_ROWS).cast("long"), F.col("c") - F.col("blk") * SHARD_ROWS))
    none = blocks.where("n_tokens <= 0").select("key", "n_tokens", copies).select(F.col("key").alias(key), "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bound", "long"), ("batch", "long"), ("slot", "long"))])
    if not bounds:
        return none
    bucket = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col("n_tokens")))
    pick = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket"))
    dealt = blocks.where("n_tokens > 0").withColumn("bucket", bucket)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "n_tokens", "blk"), pick([-(-c // SHARD_ROWS) or 1 for c in held])))
    before = Window.partitionBy("bucket", "shard").orderBy("key", "n_tokens", "blk").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("c").over(before), F.lit(0)))
    counts = dealt.groupBy("bucket", "shard").agg(F.sum("c").alias("c"))
    # one row for each SHARD_ROWS rows: small, and dealt by bucket
    offs = counts.withColumn("off", F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "shard", F.coalesce("off", F.lit(0)).alias("off"))
    at = F.col("off") + F.col("inside") + F.col("copy")
    room = pick([max(1, budget // b) for b in bounds])
    numbered = placed.join(offs, ["bucket", "shard"]).select("*", copies).select(
        F.col("key").alias(key), "n_tokens", "bucket", pick(bounds).cast("long").alias("bound"), F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot")
    )
    return numbered.unionByName(none)
