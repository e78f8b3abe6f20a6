"""Sources: JSON arrays, classified record files, picture listings, configurations, glyph profiles."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize_key
from ..operators.segment import Field, RecordFormat
from .arrays import read_array, repeated_keys, split_elements

#: Suffixes of pictures, those of pictures that give codes, kinds of record files from lowest to highest priority.
PICTURES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".bmp")
CODED = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
KINDS = ("valid", "tag-corrected", "manual-review")


class DuplicateKey(ValueError):
    pass


def strict_json(text: str):
    """json.loads that refuses objects with a repeated key at any depth."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise DuplicateKey(str([k for k, _ in items]))
        return out

    return json.loads(text, object_pairs_hook=pairs)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """Elements of JSON arrays, one array a file of any size, with their file's name, its place among the files by
    casefolded name, and their place in it. Broken text and keys that are repeated at any depth are errors."""
    rows = read_array(spark, path, schema, glob)
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("file"), "file_order", "index", "record.*")


def duplicate_key_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, element) of the first element of each file that isn't JSON or repeats a key at any depth, where Spark's own parser
    silently keeps the last of equal keys."""
    rows = split_elements(spark, path, glob).where(repeated_keys(F.col("value")))
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return rows.groupBy(name.alias("file")).agg(F.min("index").alias("element"))


def classify(files: DataFrame, name: str = "file") -> DataFrame:
    """files with prefix, kind and priority of record files. A bare ``Tap-…`` file is valid unless its name
    has ``_invalid``; other files are left out."""
    typed = f"(?i)^(.+)_({'|'.join(KINDS)})\\.json$"
    bare = "(?i)^(Tap-.+)\\.json$"
    c = F.col(name)
    is_typed = c.rlike(typed)
    is_bare = ~is_typed & c.rlike(bare) & ~F.lower(c).contains("_invalid")
    out = files.where(is_typed | is_bare)
    kind = F.when(is_typed, F.lower(F.regexp_extract(c, typed, 2))).otherwise("valid")
    out = out.withColumn("prefix", F.when(is_typed, F.regexp_extract(c, typed, 1)).otherwise(F.regexp_extract(c, bare, 1))).withColumn("kind", kind)
    return out.withColumn("priority", (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1).cast("int"))


def volume_number(name):
    return F.regexp_extract(name, "(?i)Tap-([0-9]+)", 1).cast("int")


def list_pictures(spark: SparkSession, path: str, suffixes: tuple[str, ...] = PICTURES) -> DataFrame:
    """(path, file, stem, code) of the pictures of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.lower("file").rlike(f"({'|'.join(x.replace('.', '[.]') for x in suffixes)})$"))
    stem = F.regexp_replace("file", "\\.[^.]+$", "")
    return files.withColumn("stem", stem).withColumn("code", normalize_key(F.col("stem")))


def picture_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes of a folder's pictures, of the suffixes that give codes."""
    return list_pictures(spark, path, CODED).select("code").distinct()


def used_codes(streams: DataFrame, font: str = "font") -> DataFrame:
    """Distinct (font, code) of hexadecimal runs ``<…>`` in streams(font, content)."""
    from ..functions.text import hex_codes

    runs = streams.select(font, F.explode(F.regexp_extract_all("content", F.lit("<([0-9A-Fa-f\\s]+)>"), 1)).alias("run"))
    return runs.select(font, F.explode(hex_codes(F.col("run"))).alias("code")).distinct()


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(signature, glyph, codepoint, unicode, char) of a profile, one JSON object keyed by signature."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,struct<glyph:string,codepoint:int,unicode:string,char:string>>")
    return raw.select(F.explode(m).alias("signature", "v")).select("signature", "v.*")


def _exact(d: dict, keys: set[str], where: str) -> None:
    if set(d) != keys:
        raise ValueError(f"{where}: missing {sorted(keys - set(d))}, unknown {sorted(set(d) - keys)}")


@dataclass(frozen=True)
class VolumeConfig:
    format: RecordFormat
    top: float
    bottom: float
    footnote: str | None
    footnote_size: float


def java_pattern(pattern: str) -> str:
    """Named groups in the spelling of Java."""
    return pattern.replace("(?P<", "(?<")


def load_config(text: str) -> VolumeConfig:
    """A volume's configuration; key sets are closed, margins are not negative, patterns have their groups."""
    d = strict_json(text)
    _exact(d, {"title", "start", "sections", "fields", "marker", "consecutive", "margins", "footnote"}, "config")
    _exact(d["margins"], {"top", "bottom"}, "margins")
    if min(d["margins"].values()) < 0:
        raise ValueError("margins must not be negative")
    import re

    fields = []
    for i, f in enumerate(d["fields"]):
        _exact(f, {"label", "name", "type", "required"}, f"fields[{i}]")
        if f["type"] not in ("string", "identifiers"):
            raise ValueError(f"fields[{i}].type: {f['type']}")
        fields.append(Field(**f))
    for name, groups in (("title", 1), ("marker", 2)):
        if re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", java_pattern(d[name]))).groups < groups:
            raise ValueError(f"{name}: {groups} groups are needed")
    foot = d["footnote"] or {"pattern": None, "size": 0}
    _exact(foot, {"pattern", "size"}, "footnote")
    fmt = RecordFormat(java_pattern(d["title"]), d["start"], tuple(d["sections"]), tuple(fields), java_pattern(d["marker"]), bool(d["consecutive"]))
    return VolumeConfig(fmt, float(d["margins"]["top"]), float(d["margins"]["bottom"]), foot["pattern"], float(foot["size"]))


def repeated_stems(pictures: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, n) of names that more than one picture has; a folder is usable only where there are none."""
    return pictures.groupBy(stem).agg(F.count("*").alias("n")).where("n > 1")


@dataclass(frozen=True)
class Project:
    """A volume's configuration with its files, resolved against the folder of the configuration."""

    volume: VolumeConfig
    files: dict[str, str]
    fonts: dict[str, str]
    show_metadata: bool


def _kind(value, kinds: tuple, where: str, ok: bool = True):
    if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds) or not ok:
        raise ValueError(f"{where}: {value!r}")
    return value


def _word(value, where: str) -> str:
    return _kind(value, (str,), where, isinstance(value, str) and bool(value.strip()))


def load_project(text: str, folder: str) -> Project:
    """The nested file layout (fixed names of members): sources, paths, fonts, page filter, record format.

    Key sets are closed and every value is checked; what is wrong is named by its path in the ValueError."""
    import re
    from pathlib import Path

    d = _kind(strict_json(text), (dict,), "root")
    _exact({k: v for k, v in d.items() if k != "gradio"}, {"input_pdf_path", "paths", "encoded_fonts", "page_filter", "records"}, "root")
    at = lambda value, where: str(Path(folder, Path(_word(value, where)).expanduser()).resolve())
    for where, value, keys in (("paths", d["paths"], {"output_json", "glyph_profile"}), ("page_filter", d["page_filter"], {"margins", "footnotes"}), ("records", d["records"], {"title_pattern", "metadata", "content", "face_marker_pattern", "require_consecutive_numbers"})):
        _exact(_kind(value, (dict,), where), keys, where)
    files = {"input_pdf_path": at(d["input_pdf_path"], "input_pdf_path")} | {k: at(v, f"paths.{k}") for k, v in d["paths"].items()}
    show = False
    if "gradio" in d:
        ui = dict(_kind(d["gradio"], (dict,), "gradio"))
        show = _kind(ui.pop("show_metadata_fields", False), (bool,), "gradio.show_metadata_fields")
        _exact(ui, {"image_dir", "output_dir"}, "gradio")
        files |= {k: at(v, f"gradio.{k}") for k, v in ui.items()}
    fonts = {_word(k, "encoded_fonts"): at(v, f"encoded_fonts.{k}") for k, v in _kind(d["encoded_fonts"], (dict,), "encoded_fonts").items()}
    names = ["".join(c for c in k.casefold() if c.isalnum()) for k in fonts]
    _kind(names, (list,), "encoded_fonts: names that are alike", len(set(names)) == len(names))
    margins, foot, rec = d["page_filter"]["margins"], d["page_filter"]["footnotes"], d["records"]
    _exact(_kind(margins, (dict,), "page_filter.margins"), {"top", "bottom"}, "page_filter.margins")
    for k, v in margins.items():
        _kind(v, (int, float), f"page_filter.margins.{k}", not isinstance(v, (int, float)) or v >= 0)
    pattern, size = None, 0.0
    if foot is not None:
        _exact(_kind(foot, (dict,), "page_filter.footnotes"), {"start_pattern", "max_font_size"}, "page_filter.footnotes")
        pattern, size = _word(foot["start_pattern"], "start_pattern"), foot["max_font_size"]
        _kind(size, (int, float), "max_font_size", not isinstance(size, (int, float)) or size > 0)
    content = _kind(rec["content"], (dict,), "records.content")
    _exact(content, {"start_heading", "section_headings"}, "records.content")
    heads = _kind(content["section_headings"], (list,), "section_headings", bool(content["section_headings"]))
    for h in heads:
        _word(h, "section_headings")
    fields = []
    for i, f in enumerate(_kind(rec["metadata"], (list,), "records.metadata", bool(rec["metadata"]))):
        where = f"records.metadata[{i}]"
        _exact(_kind(f, (dict,), where), {"label", "field", "type", "required"}, where)
        name = _word(f["field"], f"{where}.field")
        _kind(name, (str,), f"{where}.field", name not in {x.name for x in fields} | {"so_van_bia", "noi_dung"})
        _kind(f["type"], (str,), f"{where}.type", f["type"] in ("string", "identifiers"))
        fields.append(Field(_word(f["label"], f"{where}.label"), name, f["type"], _kind(f["required"], (bool,), f"{where}.required")))
    found = {}
    for name, group in (("title_pattern", "number"), ("face_marker_pattern", "id"), ("start_pattern", None)):
        p = pattern if name == "start_pattern" else _word(rec[name], f"records.{name}")
        if p is None:
            continue
        try:
            found[name] = re.compile(p)
        except re.error as e:
            raise ValueError(f"{name}: {e}") from e
        if group is not None and group not in found[name].groupindex:
            raise ValueError(f"{name}: group {group} is needed")
    fmt = RecordFormat(
        _numbered(found["title_pattern"], "number"), _word(content["start_heading"], "start_heading"), tuple(heads), tuple(fields),
        _numbered(found["face_marker_pattern"], "id", "rest"), _kind(rec["require_consecutive_numbers"], (bool,), "require_consecutive_numbers"),
    )
    return Project(VolumeConfig(fmt, float(margins["top"]), float(margins["bottom"]), pattern and java_pattern(pattern), float(size)), files, fonts, show)


def _numbered(pattern, *groups: str) -> str:
    """A pattern in Java's spelling; the parser reads its groups by number, so the named ones must come first."""
    have = [pattern.groupindex.get(g, 0) for g in groups]
    if have != list(range(1, len(groups) + 1)):
        raise ValueError(f"{pattern.pattern}: groups {groups} must be the first")
    return java_pattern(pattern.pattern)
