"""A source of record files that is parsed only where it changed, with an index from face codes to places.

The parsed records, a table of the files that they came from, and the index are three outputs of one committed version.
A refresh lists the source, holds the listing against that table, parses new and changed files, and publishes all
three together; rows of a file that has gone or changed stop counting because the table no longer names their generation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import lookup
from .arrays import read_array
from .commits import Version, commit, read_output, read_version

_KEYS = ["file", "mtime", "length"]


@dataclass(frozen=True)
class Refreshed:
    version: int
    parsed: tuple[str, ...]  # files
    gone: tuple[str, ...]


def escaped(path: str) -> str:
    """A path that is read as it is, not as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


class RecordCache:
    """Records of JSON arrays under ``source``, kept under ``root``; a record has an array ``faces`` of structs with a ``code``."""

    def __init__(self, spark: SparkSession, source: str, root: str, schema: str | StructType, glob: str = "*.json", faces: str = "noi_dung", code: str = "ky_hieu", buckets: int = 32):
        self.spark, self.source, self.root, self.schema, self.glob = spark, source, root, schema, glob
        self.faces, self.code, self.buckets = faces, code, buckets

    def _bucket(self, code: Column) -> Column:
        return F.pmod(F.xxhash64(code), F.lit(self.buckets)).cast("int")

    def _listing(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", self.glob).load(self.source)
        return files.select(F.col("_metadata.file_path").alias("file"), "path", F.unix_micros("modificationTime").alias("mtime"), "length")

    def refresh(self) -> Refreshed:
        """Brings the cache up to date; without a change nothing is parsed or written. Files whose time and length stayed are not read.
        A file that cannot be parsed is an error and leaves the version before."""
        before = read_version(self.root)
        listing = self._listing()
        if before.number:
            known = read_output(self.spark, self.root, "files", before.number)
            state = listing.join(known, _KEYS, "left")
            gone = tuple(sorted(r.file for r in known.join(listing, "file", "left_anti").select("file").collect()))
        else:
            state, gone = listing.withColumn("gen", F.lit(None).cast("long")), ()
        # names of files, which Spark's own listing holds on the driver too
        changed = state.where("gen is null").select("file", "path").collect()
        if not changed and not gone:
            return Refreshed(before.number, (), ())
        gen = before.number + 1
        outputs = {"files": state.select(*_KEYS, F.coalesce("gen", F.lit(gen).cast("long")).alias("gen"))}
        if changed:
            outputs |= self._parsed([escaped(r.path) for r in changed], gen)
        commit(self.spark, self.root, outputs, replace=["files"], expected=before.number, split={"index": "bucket"})
        return Refreshed(gen, tuple(sorted(r.file for r in changed)), gone)

    def _parsed(self, paths: Sequence[str], gen: int) -> dict[str, DataFrame]:
        records = read_array(self.spark, paths, self.schema, "*").select("file", F.lit(gen).cast("long").alias("gen"), "index", "record")
        return {"records": records, "index": self._index_of(records)}

    def _index_of(self, records: DataFrame) -> DataFrame:
        faces = records.select("file", "gen", "index", F.posexplode(f"record.{self.faces}").alias("face", "f"))
        code = F.coalesce(F.col(f"f.{self.code}").cast("string"), F.lit("None"))
        return faces.select(code.alias("code"), "file", "gen", "index", "face").withColumn("bucket", self._bucket(F.col("code")))

    def _live(self, rows: DataFrame, version: Version) -> DataFrame:
        files = read_output(self.spark, self.root, "files", version.number)
        return rows.join(files.select("file", "gen"), ["file", "gen"], "left_semi")

    def records(self) -> DataFrame:
        """(file, gen, index, record) as of the latest version."""
        v = read_version(self.root)
        return self._live(read_output(self.spark, self.root, "records", v.number), v)

    def index(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """(code, file, gen, index, face); of some buckets only if named: their files alone are read."""
        v = read_version(self.root)
        names = [f"index/{b}" for b in (range(self.buckets) if buckets is None else buckets) if f"index/{b}" in v.schemas]
        if not names:
            return self.spark.createDataFrame([], "code string, file string, gen long, index long, face int")
        return self._live(read_output(self.spark, self.root, names, v.number), v)

    def locate(self, images: DataFrame, image: str = "image") -> DataFrame:
        """images with the place of their face: (code, matches, file, index, face). The code is the name without its suffix; where no
        face has it and it is all digits, it counts without leading zeros. Only with one match the place isn't null.
        Buckets of the index that no code falls into are not read."""
        stem = F.regexp_replace(image, r"(?<=.)\.[^.]+$", "")
        asked = images.withColumn("code", stem)
        bare = F.when(F.col("code").rlike("^[0-9]+$"), F.regexp_replace("code", "^0+(?=[0-9])", ""))
        both = F.explode(F.array_compact(F.array(self._bucket(F.col("code")), F.when(bare.isNotNull(), self._bucket(bare)))))
        needed = sorted(r.b for r in asked.select(both.alias("b")).distinct().collect())  # as many as buckets at most
        index = self.index(needed)
        found = lookup(asked, index, "code", "code")
        place = index.groupBy("code").agg(F.count("*").alias("__n"), F.min(F.struct("file", "index", "face")).alias("__p")).where("__n = 1").withColumnRenamed("code", "matched")
        out = found.join(place, "matched", "left")
        return out.select(*images.columns, "code", F.col("match_count").alias("matches"), "__p.file", "__p.index", "__p.face")

    def compact(self) -> Version:
        """Writes the live rows anew and drops those of files that have gone or changed."""
        v = read_version(self.root)
        index = self.index()
        every = {name: read_output(self.spark, self.root, name, v.number) for name in ("files", "records")}
        outputs = {"records": self._live(every["records"], v), "index": index.withColumn("bucket", self._bucket(F.col("code")))}
        stale = [n for n in v.files if n.startswith("index/")]
        return commit(self.spark, self.root, outputs, replace=["records", *stale], expected=v.number, split={"index": "bucket"})
