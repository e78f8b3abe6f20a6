"""Reference fonts of a project: the best file of each embedded font, written back to the project's file where that changed."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.glyphs import best_reference, embedded_fonts
from .readers import strict_json
from .sinks import swap_if_unchanged


@dataclass(frozen=True)
class FontSync:
    found: tuple[str, ...]
    missing: tuple[str, ...]
    changed: bool


def synchronize_fonts(project: str | Path, fonts: DataFrame, references: DataFrame) -> FontSync:
    """Sets ``encoded_fonts`` of a project's file to the reference files of its embedded fonts, by paths from its folder.

    fonts are those of ``embedded_fonts`` (name, xref, type, ext, encoding), references (key, file, style_priority) the files that fit a font's normalised name. Fonts
    without a file are left out and named. The file is written only if the mapping changed, as a whole, and not over a change that
    another writer has made since it was read. The fonts of one document are few and come to the driver."""
    project = Path(project)
    used = embedded_fonts(fonts)
    files = {r.key: r.file for r in best_reference(used.select("key"), references).collect()}
    rows = sorted(used.select("name", "key").collect(), key=lambda r: r["name"].casefold())
    have = {r["name"]: os.path.relpath(files[r["key"]], project.resolve().parent) for r in rows if r["key"] in files}
    missing = tuple(r["name"] for r in rows if r["key"] not in files)
    before = strict_json(project.read_text(encoding="utf-8"))
    changed = before.get("encoded_fonts") != have
    if changed:
        swap_if_unchanged(project, before, before | {"encoded_fonts": have})
    return FontSync(tuple(have), missing, changed)
