"""Sinks: JSON, CSV with a byte order mark, ZIP export, atomic files, registries."""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
import textwrap
import unicodedata
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_characters
from ..operators.relational import upsert


@contextmanager
def replacing(path: str | Path) -> Iterator[BinaryIO]:
    """A file beside the target that takes its place, synced, when the block ends well, and goes when it fails."""
    path = Path(path)
    with tempfile.NamedTemporaryFile(dir=path.parent, prefix=f".{path.name}.", delete=False) as f:
        try:
            yield f
            f.flush()
            os.fsync(f.fileno())
            os.replace(f.name, path)
        except BaseException:
            os.unlink(f.name)
            raise


def replace_file(path: str | Path, data: bytes) -> None:
    with replacing(path) as f:
        f.write(data)


def check_text(value, path: str = "$") -> None:
    """Refuses U+FFFD, surrogates and control characters other than line breaks, at any depth."""
    if isinstance(value, str):
        for c in value:
            if c == "�" or (c != "\n" and unicodedata.category(c) in ("Cc", "Cs")):
                raise ValueError(f"{path}: U+{ord(c):04X}")
    elif isinstance(value, dict):
        for k, v in value.items():
            check_text(k, path)
            check_text(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            check_text(v, f"{path}[{i}]")


def text_problems(df: DataFrame, key: str) -> DataFrame:
    """(key, column) of the string columns that ``check_text`` would refuse."""
    bad = [F.when(bad_characters(F.col(c)), F.lit(c)) for c, t in df.dtypes if t == "string"]
    return df.select(key, F.explode(F.array_compact(F.array(*bad))).alias("column")) if bad else df.select(key, F.lit("").alias("column")).where("false")


def _stream_lines(df: DataFrame) -> Iterator[str]:
    return (r.j for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())


def write_json_array(df: DataFrame, path: str | Path, pretty: bool = False) -> int:
    """One array in one local file, rows in their order. Rows go through the driver to the file one by one; arrays that tasks
    write are in ``arrays.write_arrays``."""
    n = 0
    with replacing(path) as f:
        for line in _stream_lines(df):
            row = json.loads(line)
            check_text(row)
            f.write(((",\n" if pretty else ",") if n else ("[\n" if pretty else "[")).encode())
            f.write((json.dumps(row, ensure_ascii=False, indent=2) if pretty else line).encode())
            n += 1
        f.write((b"\n]\n" if pretty else b"]\n") if n else (b"[\n\n]\n" if pretty else b"[]\n"))
    return n


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_bom(df: DataFrame, path: str | Path) -> None:
    """A report as one local CSV file with a byte order mark, header first, row by row."""
    import csv
    import io

    with replacing(path) as f:
        text = io.TextIOWrapper(f, "utf-8-sig", newline="", write_through=True)
        w = csv.writer(text, lineterminator="\n")
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
        text.detach()


def write_zip(arrays: dict[str, DataFrame], path: str | Path) -> dict[str, int]:
    """Each DataFrame as one JSON array in a ZIP file, element by element."""
    n = dict.fromkeys(arrays, 0)
    with replacing(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in arrays.items():
            with z.open(f"{name}.json", "w", force_zip64=True) as member:
                for line in _stream_lines(df):
                    text = json.dumps(json.loads(line), ensure_ascii=False, indent=2)
                    member.write(((",\n" if n[name] else "[\n") + textwrap.indent(text, "  ")).encode())
                    n[name] += 1
                member.write(b"\n]\n" if n[name] else b"[]\n")
    return n


def fingerprint(document: dict) -> str:
    """SHA-256 of the document as JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def save_registry(old: DataFrame, new: DataFrame, path: str, key: str = "image", seq: str = "seq") -> None:
    """Latest row of each key, in the order in which keys were first inserted, written to a new folder."""
    merged = upsert(old, new, key, seq)
    merged.orderBy("first_seq").write.mode("errorifexists").parquet(path)


def swap_if_unchanged(path: str | Path, expected: dict, document: dict) -> None:
    """Replaces a JSON file only if it still holds what was read. A lock on a file beside it keeps other writers out between the
    comparison and the swap."""
    path = Path(path)
    check_text(document)
    with open(path.with_name(f".{path.name}.lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if json.loads(path.read_text()) != expected:
            raise RuntimeError(f"{path.name} has changed")
        replace_file(path, (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode())
