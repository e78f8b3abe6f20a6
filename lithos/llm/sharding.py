"""Sharding by vector bin packing of bytes, tokens and rows.

Rows of equal texts form groups, which stay whole unless one can't fit a shard. Groups of some weight are
placed one by one; the many small ones are hashed to cells, whose number is fixed, so the driver packs a
bounded number of vectors however large the table is. Vectors are placed in falling order, each where its
dot product with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import word_count
from .store import cut

#: Cells that small groups are hashed to; a group over 1 / (shards * HEAVY) of any total is placed by itself, so
#: there are at most 3 * shards * HEAVY of those.
CELLS, HEAVY = 4096, 512
#: Pieces to a shard that a group is cut into if it holds more than a whole shard's share of any total.
PIECES = 64
#: Rows that share one count when places are numbered.
SLOT_ROWS = 2000


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector. Capacities are an equal share of each total; a total of 0 weighs nothing."""
    total = vectors.sum(0)
    v = vectors / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, v.shape[1]))
    out = np.empty(len(v), int)
    for i in np.lexsort((np.arange(len(v)), -v.max(1))):
        out[i] = int((left @ v[i]).argmax())
        left[out[i]] -= v[i]
    return out


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, tokens, text_crc32, shard, slot) of every row. size: UTF-8 bytes of the text plus 1; a
    null text counts as empty. slot counts the rows of a shard without gaps from 0. Equal texts are in
    one shard; only a group that holds over 1 / shards of all bytes, tokens or rows, which no shard can take, is cut.
    Ties of the packing go to the lower shard, places to hashed lots and in them to the smaller key. Repeated
    rows are each placed; other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), word_count(t).alias("tokens"), F.crc32(t).alias("crc"), F.xxhash64(t).alias("h"))
    # rows of the same key and text are one row with a count until the last step
    rows = cut(rows.withColumn("grp", F.xxhash64("h", "crc", "size")).groupBy("key", "grp", "size", "tokens", "crc").agg(F.count("*").alias("n")))
    sums = [F.sum(F.col("size") * F.col("n")).alias("size"), F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("rows")]
    groups = rows.groupBy("grp").agg(*sums)
    total = groups.agg(*[F.sum(c).alias(c) for c in ("size", "tokens", "rows")]).first()
    share = F.greatest(*[F.col(c) / F.lit(float(total[c] or 1)) for c in ("size", "tokens", "rows")]) * shards
    heavy = groups.select("grp", share.alias("share")).where(F.col("share") > 1 / HEAVY).collect()
    pieces = [(int(g), int(-(-s * PIECES // 1)) if s > 1 else 1) for g, s in sorted(heavy)]
    heavy_df = spark.createDataFrame(pieces, "grp long, pieces int")
    # blocks of at most SLOT_ROWS repeats: what of a hot key goes through a window is small
    blocks = rows.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOT_ROWS)))).withColumn("n", F.least(F.lit(SLOT_ROWS).cast("long"), F.col("n") - F.col("blk") * SLOT_ROWS))
    cell = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64(F.lit("cell"), "grp"), F.lit(CELLS))).otherwise(F.lit(CELLS) + F.pmod(F.xxhash64("grp", F.pmod(F.xxhash64("key", "blk"), "pieces")), F.lit(1 << 60)))
    dealt = blocks.join(F.broadcast(heavy_df), "grp", "left").withColumn("unit", cell.cast("long"))
    units = dealt.groupBy("unit").agg(*sums).collect()
    units.sort(key=lambda r: r.unit)
    at = place(np.array([[r.size, r.tokens, r["rows"]] for r in units], float).reshape(-1, 3), shards)
    where = spark.createDataFrame([(r.unit, int(s), -(-r["rows"] // SLOT_ROWS)) for r, s in zip(units, at, strict=True)], "unit long, shard int, subs int")
    placed = dealt.join(F.broadcast(where), "unit").withColumn("sub", F.pmod(F.xxhash64(F.lit("slot"), "key", "grp", "blk"), "subs").cast("int"))
    counts = placed.groupBy("shard", "unit", "sub").agg(F.sum("n").alias("c"))
    before = Window.partitionBy("shard").orderBy("unit", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("unit", "sub", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("unit", "sub").orderBy("key", "grp", "blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("inside", inside).join(offs, ["unit", "sub"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return numbered.select(F.col("key").alias(key), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("off") + F.col("inside") + F.col("copy")).cast("long").alias("slot"))
