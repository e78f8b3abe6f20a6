"""A registry of the latest row of each key, to which batches are added at the cost of the batch.

Keys are hashed to buckets. A batch becomes one new file for each bucket that it touches; reading takes the last row of
each key over the files of its bucket, and compaction rewrites the buckets that have gathered many. Every step is one
committed version, and the version remembers the last batch of each writer, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Version, commit, read_output, read_version


class Registry:
    """One row per ``key``, the last by ``order``; ``first_seq`` is the order at which the key was first inserted. Rows that are
    equal in ``order`` are told apart by all their columns, so that every run keeps the same one."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: Sequence[str], buckets: int = 16):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root, key, list(order), buckets

    def _latest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in ("first_seq", "bucket")]
        last = F.max_by(F.struct(*columns), F.struct(*[F.col(c) for c in self.order], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
        first = F.min("first_seq") if "first_seq" in rows.columns else F.min(F.struct(*self.order))
        return rows.groupBy(F.col(self.key).alias("__k")).agg(last.alias("r"), first.alias("first_seq")).select("r.*", "first_seq")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, batch: DataFrame, writer: str = "", number: int | None = None) -> Version:
        """Adds a batch. With a number, a batch of that writer that isn't after the last one is left out: it was committed."""
        before = read_version(self.root)
        done = before.notes.get("batches", {})
        if number is not None and number <= done.get(writer, -1):
            return before
        notes = {} if number is None else {"batches": done | {writer: number}}
        rows = self._bucketed(self._latest(batch))
        # one file a bucket; a bucket of a batch is small, as a key has one row in it
        rows = rows.repartition(self.buckets, "bucket")
        return commit(self.spark, self.root, {"bucket": rows}, expected=before.number, notes=notes, split={"bucket": "bucket"})

    def read(self, version: int | None = None) -> DataFrame | None:
        """The registry as of a version; None before the first batch."""
        v = read_version(self.root, version)
        return self._latest(read_output(self.spark, self.root, sorted(v.files), v.number)) if v.files else None

    def compact(self, least: int = 4) -> Version:
        """Rewrites the buckets that have at least so many files, each to one."""
        v = read_version(self.root)
        many = [n for n in sorted(v.files) if len(v.files[n]) >= least]
        if not many:
            return v
        rows = self._bucketed(self._latest(read_output(self.spark, self.root, many, v.number))).repartition(len(many), "bucket")
        return commit(self.spark, self.root, {"bucket": rows}, replace=many, expected=v.number, split={"bucket": "bucket"})
