"""JSON arrays of any size: files are split like text, and written by tasks.

Spark's own text source cuts a file into blocks and these, at every ``}``, into pieces, so one file is read by many tasks from
any store that Spark reads. Where the elements of the array begin depends on all the text before: whether a block
begins inside a string, and how deep. A first pass therefore sums up each block for both cases (in a string or not):
the end state, the change of depth, and the commas at each depth. A prefix scan of these sums, one small row a block,
gives every block its true start, and the second pass cuts the elements.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import store_of

#: Bytes of text that are looked at at once.
CHUNK = 4 << 20

_QUOTE, _ESCAPE, _COMMA = (ord(c) for c in '"\\,')
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
#: White space of JSON.
_BLANK = b" \t\n\r"


def _chunks(values: pa.Array) -> Iterator[bytes]:
    """The pieces with the ``}`` that cut them, some megabytes at a time."""
    part, size = [], 0
    for v in values.to_pylist():
        part.append(v)
        size += len(v)
        if size >= CHUNK:
            yield ("}".join(part) + "}").encode()
            part, size = [], 0
    if part:
        yield ("}".join(part) + "}").encode()


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of each byte of a chunk, which has some, whether it is outside strings, and the depth after it, from depth 0; and
    whether a string is open at the end. Text before the chunk ends in ``}``, so no escape reaches into it."""
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(data != _ESCAPE, at, -1))
    run = np.concatenate([[0], (at - last)[:-1]])  # backslashes right before each byte
    quotes = np.cumsum((data == _QUOTE) & (run % 2 == 0)) + inside
    outside = quotes % 2 == 0
    return outside, np.cumsum(np.where(outside, _STEP[data], 0)), bool(quotes[-1] % 2)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, pa.Array]]:
    """(file, size, block, pieces) of neighbouring rows of one block."""
    file, block = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield file.dictionary[int(code[a])].as_py(), batch.column(1)[a].as_py(), int(block[a]), batch.column(3).slice(a, b - a)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, list] = {}
    for batch in batches:
        for file, size, block, pieces in _runs(batch):
            state = seen.setdefault((file, size, block), [0, [False, 0, Counter()], [True, 0, Counter()]])
            for text in _chunks(pieces):
                data = np.frombuffer(text, np.uint8)
                state[0] += len(data)
                for case in state[1:]:
                    outside, depth, case[0] = structure(data, case[0])
                    level, n = np.unique(depth[outside & (data == _COMMA)] + case[1], return_counts=True)
                    case[2].update(dict(zip(level.tolist(), n.tolist(), strict=True)))
                    case[1] += int(depth[-1])
    rows = [(*k, v[0], started, ends, change, [(int(a), int(b)) for a, b in commas.items()]) for k, v in seen.items() for started, (ends, change, commas) in zip((False, True), v[1:], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) if i < 7 else pa.array(c, pa.map_(pa.int64(), pa.int64())) for i, c in enumerate(zip(*rows, strict=True))], ["file", "size", "block", "bytes", "started", "ends", "change", "commas"])


_SUMS = "file string, size long, block long, bytes long, started boolean, ends boolean, change long, commas map<long,long>"


def starts(sums: list) -> tuple[dict[tuple[str, int], tuple[bool, int, int]], dict[str, int]]:
    """The prefix scan: (in a string, depth, elements before) at the start of each block, and the commas between the
    elements of each file. What isn't one whole array is refused."""
    by: dict[str, dict[int, dict[bool, tuple]]] = {}
    for r in sums:
        by.setdefault(r.file, {}).setdefault(r.block, {})[r.started] = r
    out, between = {}, {}
    for file, blocks in by.items():
        inside, depth, index, size = False, 0, 0, 0
        for block in sorted(blocks):
            out[file, block] = inside, depth, index
            r = blocks[block][inside]
            index += r.commas.get(1 - depth, 0)
            inside, depth, size = r.ends, depth + r.change, size + r.bytes
        # the last piece has a } of its own, which the file has not
        if inside or depth != -1 or size != r.size + 1:
            raise ValueError(f"{file}: not one whole JSON array")
        between[file] = index
    return out, between


def _cutter(start: dict[tuple[str, int], tuple[bool, int, int]], order: dict[str, int]):
    """Elements (file, order, index, block, whole, value); what reaches over an end of its block isn't whole."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def element(here: tuple[str, int], index: int, part: list[bytes], whole: bool, alone: bool) -> list[tuple]:
        text = b"".join(part)
        if whole and not text.strip(_BLANK):
            if alone:
                return []  # of an empty array
            raise ValueError(f"{here[0]}: element {index} is empty")
        return [(here[0], order[here[0]], index, here[1], whole, text.decode())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "file_order", "index", "block", "whole", "value"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, depth, index, open_, part, whole = None, False, 0, 0, False, [], False
        rows: list[tuple] = []
        for batch in batches:
            for file, _, block, pieces in _runs(batch):
                if here != (file, block):
                    if open_:
                        rows += element(here, index, part, False, False)
                    here = file, block
                    inside, depth, index = start[here]
                    open_, part, whole = depth > 0 or inside, [], False
                for text in _chunks(pieces):
                    data = np.frombuffer(text, np.uint8)
                    outside, level, inside = structure(data, inside)
                    level, step, at = level + depth, _STEP[data], 0
                    marks = outside & (((data == _COMMA) & (level == 1)) | ((step < 0) & (level == 0)) | ((step > 0) & (level == 1)))
                    for e in np.flatnonzero(marks).tolist():
                        if step[e] > 0:  # the bracket that opens the array
                            if open_ or text[at:e].strip(_BLANK) or data[e] != ord("["):
                                raise ValueError(f"{file}: not an array")
                            open_, part, whole = True, [], True
                        else:
                            part.append(text[at:e])
                            rows += element(here, index, part, whole, index == 0 and step[e] < 0)
                            open_, part, whole, index = data[e] == _COMMA, [], True, index + 1
                        at = e + 1
                    if open_:
                        part.append(text[at:])
                    elif text[at:].strip(_BLANK) not in (b"", b"}"):
                        raise ValueError(f"{file}: text outside the array")
                    depth = int(level[-1])
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        if open_:
            rows += element(here, index, part, False, False)
        if rows:
            yield batch_of(rows)

    return task


def split_elements(spark: SparkSession, path: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """(file, file_order, index, value) of the elements of JSON arrays, one array a file. file is the file's path, file_order its place
    among the files by casefolded name, index the element's place in its file, value its text. A file that isn't one whole array is refused here, an
    empty element when it is read."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")
    # one row of sums for each of the blocks that the driver deals out itself
    start, between = starts(raw.mapInArrow(_sums, _SUMS).collect())
    plain = lambda f: unquote(f).split(":", 1)[-1].lstrip("/")
    if empty := {plain(f) for f in raw.inputFiles()} - {plain(f) for f in between}:
        raise ValueError(f"{min(empty)}: empty file")
    order = {f: i for i, f in enumerate(sorted(between, key=lambda f: (unquote(f.rsplit("/", 1)[-1]).casefold(), f)))}
    cut = raw.mapInArrow(_cutter(start, order), "file string, file_order int, index long, block long, whole boolean, value string")
    parts = cut.where("not whole").groupBy("file", "file_order", "index").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
    joined = parts.select("file", "file_order", "index", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    blank = F.trim(F.translate("value", "\t\n\r", "   ")) == ""
    alone = F.col("file").isin([f for f, n in between.items() if not n])
    joined = joined.where(~(blank & alone)).withColumn("value", F.when(blank, F.raise_error(F.concat("file", F.lit(": an element is empty")))).otherwise(F.col("value")))
    return cut.where("whole").select("file", "file_order", "index", "value").unionByName(joined)


def repeated_keys(value: Column) -> Column:
    """Whether a JSON text is broken or has an object, at any depth, that repeats a key. The parser stops after a first value; as
    an element of an array a second one is an error."""
    return F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))).isNull()


def read_array(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """(file, file_order, index, record) of the elements, record being of the schema, a DDL list of fields or a type; text that isn't
    JSON, a key that is repeated at any depth, or a value of another type is an error."""
    rows = split_elements(spark, path, glob)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    if not kind.lower().startswith(("struct<", "array<", "map<")):
        kind = f"struct<{kind}>"
    told = F.concat("file", F.lit(": element "), F.col("index").cast("string"), F.lit(" is not JSON or repeats a key"))
    value = F.when(repeated_keys(F.col("value")), F.raise_error(told)).otherwise(F.col("value"))
    return rows.select("file", "file_order", "index", F.from_json(value, kind, {"mode": "FAILFAST"}).alias("record"))


def write_arrays(df: DataFrame, path: str, file: str, order: Sequence[str | Column]) -> list[str]:
    """One JSON array for each value of the column ``file``, as ``path/<file>.json``, its rows by ``order``; returns the names. The rows of
    a file are sorted and written by one task, which spills; the driver holds none and only gives the files their
    names, replacing files of the same name. Null fields are kept; a null file is an error."""
    by = Window.partitionBy(file).orderBy(*order)
    text = F.to_json(F.struct(*[c for c in df.columns if c != file]), {"ignoreNullFields": "false"})
    first, last = F.lag(F.lit(1)).over(by).isNull(), F.lead(F.lit(1)).over(by).isNull()
    line = F.concat(F.when(first, "[").otherwise(""), text, F.when(last, "]").otherwise(","))
    name = F.when(F.col(file).isNull(), F.raise_error(F.lit("a row names no file"))).otherwise(F.col(file).cast("string"))
    beside = f"{path.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    df.select(name.alias("file"), line.alias("value")).write.partitionBy("file").text(beside)
    store, at = store_of(beside)
    names = []
    for found in store.get_file_info(pafs.FileSelector(at, recursive=True)):
        if found.is_file and not found.base_name.startswith(("_", ".")):
            names.append(unquote(found.path.rsplit("/", 2)[1].split("=", 1)[1]))
            final = f"{at.rsplit('/', 1)[0]}/{names[-1]}.json"
            if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(final).type != pafs.FileType.NotFound:
                store.delete_file(final)
            store.move(found.path, final)
    store.delete_dir(at)
    return sorted(names)
