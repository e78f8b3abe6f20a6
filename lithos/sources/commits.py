"""Several outputs that are committed as one version, by tasks that write beside and a driver that publishes.

Under a root, ``data/<transaction>/`` holds what tasks wrote and ``versions/<number>.json`` names, for each output, the
files that belong to it. A version is published by creating its file, which only one writer can do; until then
readers see the version before. A failed task, a failed commit or a lost driver leaves that one as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    """A published state: files (relative to the root) and schema of each output, and the writer's notes."""

    number: int = 0
    files: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


def store_of(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))


def schema_text(schema: StructType) -> str:
    """A schema as it is noted: anything may be null, as Parquet reads it, so that batches differ only by their types."""

    def loose(x):
        if isinstance(x, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else v if k == "metadata" else loose(v) for k, v in x.items()}
        return [loose(v) for v in x] if isinstance(x, list) else x

    return json.dumps(loose(json.loads(schema.json())))


def version_numbers(root: str) -> list[int]:
    store, at = store_of(root)
    found = store.get_file_info(pafs.FileSelector(f"{at}/versions", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def read_version(root: str, number: int | None = None) -> Version:
    """A version by its number, or the latest; an empty one where nothing was published yet."""
    store, at = store_of(root)
    if number is None:
        number = max(version_numbers(root), default=0)
    if not number:
        return Version()
    with store.open_input_stream(f"{at}/versions/{number:020d}.json") as f:
        return Version(**json.loads(f.read()))


def publish(root: str, new: Version) -> Version:
    """Creates the file of a version. Only one of several writers of the same number succeeds: a link (on a local disk) or
    a rename (elsewhere, as HDFS does it) does not replace a file that is there."""
    store, at = store_of(root)
    store.create_dir(f"{at}/versions", recursive=True)
    final, beside = f"{at}/versions/{new.number:020d}.json", f"{at}/versions/.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(json.dumps(new.__dict__).encode())
    try:
        if isinstance(store, pafs.LocalFileSystem):
            os.link(beside, final)
        elif store.get_file_info(final).type == pafs.FileType.NotFound:
            store.move(beside, final)
        else:
            raise FileExistsError(final)
    except FileExistsError as e:
        raise Conflict(f"version {new.number} of {root} was published by another writer") from e
    finally:
        if store.get_file_info(beside).type != pafs.FileType.NotFound:
            store.delete_file(beside)
    return new


def discard(root: str, transaction: str) -> None:
    store, at = store_of(root)
    if store.get_file_info(f"{at}/data/{transaction}").type == pafs.FileType.Directory:
        store.delete_dir(f"{at}/data/{transaction}")


def parquet_files(root: str, under: str) -> list[str]:
    """Parquet files below a folder of the root, by their path from the root."""
    store, at = store_of(root)
    found = store.get_file_info(pafs.FileSelector(f"{at}/{under}", recursive=True, allow_not_found=True))
    return sorted(f.path[len(at) + 1 :] for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))


def read_output(spark: SparkSession, root: str, name: str | Sequence[str], version: int | None = None) -> DataFrame:
    """An output, or several of one schema together, as of a version; files are immutable, so a later commit doesn't disturb the reader."""
    names = [name] if isinstance(name, str) else list(name)
    v = read_version(root, version)
    if unknown := [n for n in names if n not in v.schemas]:
        raise KeyError(f"{root} has no output {unknown[0]!r}")
    if len({v.schemas[n] for n in names}) != 1:
        raise ValueError(f"outputs of several schemas: {names}")
    schema = StructType.fromJson(json.loads(v.schemas[names[0]]))
    files = [f"{root.rstrip('/')}/{f}" for n in names for f in v.files.get(n, [])]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def commit(
    spark: SparkSession, root: str, outputs: dict[str, DataFrame], replace: Sequence[str] = (), expected: int | None = None, notes: dict | None = None, split: dict[str, str] | None = None
) -> Version:
    """Writes DataFrames of any schemas beside each other and publishes them as one version. Outputs named in ``replace``
    get the new files instead of the old ones, the others besides them; those not named stay. An output in ``split`` becomes one output for
    each value of that column, ``name/value``, which readers can take by themselves. ``expected`` is the version that the outputs
    were computed from: if it isn't the latest any more, Conflict."""
    before = read_version(root)
    if expected is not None and before.number != expected:
        raise Conflict(f"{root} is at version {before.number}, not {expected}")
    tx, split = uuid.uuid4().hex, split or {}
    files = {k: [] if k in replace else list(v) for k, v in before.files.items()}
    schemas = dict(before.schemas)
    try:
        for name, df in outputs.items():
            writer, schema = df.write, df.schema
            if name in split:
                writer, schema = writer.partitionBy(split[name]), df.drop(split[name]).schema
            writer.parquet(f"{root.rstrip('/')}/data/{tx}/{name}")
            for path in parquet_files(root, f"data/{tx}/{name}"):
                part = f"{name}/{unquote(path.rsplit('/', 2)[1].split('=', 1)[1])}" if name in split else name
                files.setdefault(part, []).append(path)
                schemas[part] = schema_text(schema)
            if name not in split:
                files.setdefault(name, [])
                schemas[name] = schema_text(schema)
        return publish(root, Version(before.number + 1, files, schemas, before.notes | (notes or {})))
    except BaseException:
        discard(root, tx)
        raise


def retried(attempt: Callable[[], Version], times: int = 5) -> Version:
    """Runs read-compute-commit again after a conflict."""
    for i in range(times):
        try:
            return attempt()
        except Conflict:
            if i == times - 1:
                raise
    raise AssertionError("times is positive")


# ---------------------------------------------------------------- one DataFrame to several outputs


@dataclass
class _Files(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class _Writer(DataSourceArrowWriter):
    """Rows go to the output that their column ``output`` names; a task has one file open for each."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.root, self.column = options["path"].rstrip("/"), options.get("by", "output")
        if self.column not in schema.names:
            raise ValueError(f"rows need a column {self.column!r} that names their output")
        self.replace = [x for x in options.get("outputs", "").split(",") if x]
        if overwrite and not self.replace:
            raise ValueError("overwriting needs the option outputs: the names of those that are replaced")
        self.overwrite, self.tx = overwrite, uuid.uuid4().hex
        self.schema = StructType([f for f in schema if f.name != self.column])
        self.before = read_version(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        from pyspark import TaskContext

        store, at = store_of(self.root)
        task = TaskContext.get()
        mark = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        open_: dict[str, tuple[pq.ParquetWriter, str]] = {}
        counts: dict[str, int] = {}
        try:
            for batch in iterator:
                names = batch.column(self.column)
                if names.null_count:
                    raise ValueError("a row names no output")
                rows = batch.drop_columns([self.column])
                for name in pc.unique(names).to_pylist():
                    part = rows.filter(pc.equal(names, name))
                    if name not in open_:
                        folder = f"data/{self.tx}/{name}"
                        store.create_dir(f"{at}/{folder}", recursive=True)
                        open_[name] = pq.ParquetWriter(f"{at}/{folder}/{mark}.parquet", rows.schema, filesystem=store), f"{folder}/{mark}.parquet"
                    open_[name][0].write_batch(part)
                    counts[name] = counts.get(name, 0) + part.num_rows
        finally:
            for writer, _ in open_.values():
                writer.close()
        return _Files([(name, path, counts[name]) for name, (_, path) in open_.items()])

    def commit(self, messages) -> None:
        files = {k: [] if self.overwrite and k in self.replace else list(v) for k, v in self.before.files.items()}
        schemas = self.before.schemas | dict.fromkeys(self.replace, schema_text(self.schema))
        for name, path, _ in sorted(f for m in messages if m for f in m.files):
            files.setdefault(name, []).append(path)
            schemas.setdefault(name, schema_text(self.schema))
        publish(self.root, Version(self.before.number + 1, files, schemas, self.before.notes))

    def abort(self, messages) -> None:
        discard(self.root, self.tx)


class CommittedOutputs(DataSource):
    """``df.write.format("committed").option("path", root)``: one job that writes all outputs and one version of them.
    mode("append") adds; mode("overwrite") replaces the outputs of the option ``outputs``, also by nothing."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        return "output string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)


def write_outputs(df: DataFrame, root: str, replace: Sequence[str] = ()) -> Version:
    """Rows (output, …) of df to the outputs that they name, as one version."""
    df.sparkSession.dataSource.register(CommittedOutputs)
    df.write.format("committed").option("path", root).option("outputs", ",".join(replace)).mode("overwrite" if replace else "append").save()
    return read_version(root)
