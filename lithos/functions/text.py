"""Text expressions: cleaning, tokenising, labels, identifiers, years and output layout.

Everything is a Column of built-in expressions, but for Unicode normal forms, which Spark has no
function for: those are one vectorised UDF, fed only what needs it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the record format.
TRANSCRIPTION, SUMMARY = "Phiên âm Hán Việt", "(?ms)^\\s*toát\\s+yếu(?![\\p{L}\\p{N}_]).*"
MISSING, UNKNOWN, NO_FONT = "MISS", "□", "@"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def plain_label_key(x: str) -> str:
    flat = unicodedata.normalize("NFD", x.casefold()).translate({ord("đ"): "d", ord("ð"): "d"})
    bare = " ".join("".join(c for c in flat if not unicodedata.combining(c)).split())
    return bare.replace("ky hieu", "ki hieu")


@F.pandas_udf(StringType())
def _label_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else plain_label_key(x))


#: Signs outside of which every text is in NFC already. Latin letters up to U+02FF, those
#: of U+1E00-U+1EFF and ideographs are stable unless a mark stands among them.
UNSTABLE = "[\\x{300}-\\x{1DFF}\\x{1F00}-\\x{2FFF}\\x{F900}-\\x{10FFFF}\\p{M}]"


def nfc(text: Column) -> Column:
    """NFC; only texts that may not be in it leave the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(UNSTABLE), text)), text)


def clean_line(text: Column) -> Column:
    """NFC; without U+FFFD, control and surrogate characters; white space runs as one space; stripped."""
    bare = F.regexp_replace(nfc(text), "[\\x{FFFD}\\p{Cc}\\p{Cs}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "\\x{A0}", " "), "[\\t\\f\\x0B ]+", " "))


def label_key(text: Column) -> Column:
    """Key of a heading: no case, accents or repeated spaces; đ and ð are d."""
    return _label_key(text)


def label_remainder(text: Column, head_key: Column, label: str, label_key_text: str) -> Column:
    """What follows a label on its line: '' for the bare label, null if the line doesn't open with it.
    head_key: ``label_key`` of the text before the first colon. A head that is the label's own beginning, word by word, counts too."""
    bare = label.rstrip(":")
    exact = F.regexp_extract(text, f"(?s)^\\Q{bare}\\E(?:\\s*:\\s*(.*)|\\s+(.*)|\\s*)$", 1)
    exact2 = F.regexp_extract(text, f"(?s)^\\Q{bare}\\E(?:\\s*:\\s*(.*)|\\s+(.*)|\\s*)$", 2)
    fits = text.rlike(f"(?s)^\\Q{bare}\\E(?:\\s*:\\s*(.*)|\\s+(.*)|\\s*)$")
    loose = F.contains(text, F.lit(":")) & ((head_key == label_key_text) | F.lit(label_key_text).startswith(F.concat(head_key, F.lit(" "))))
    rest = F.trim(F.regexp_extract(text, "(?s)^[^:]*:(.*)$", 1))
    return F.when(fits, F.when(exact != "", exact).otherwise(exact2)).when(loose, rest)


def identifiers(text: Column) -> Column:
    """Every run of digits with an optional letter."""
    return F.regexp_extract_all(text, F.lit("[0-9]+[A-Za-z]?"), 0)


def normalize_key(value: Column, strip: bool = True) -> Column:
    """Codes of digits lose leading zeros; others stay. Blank codes are null when stripped."""
    v = F.trim(value.cast("string")) if strip else value.cast("string")
    out = F.when(v.rlike("^[0-9]+$"), F.regexp_replace(v, "^0+(?=.)", "")).otherwise(v)
    return F.when(v != "", out) if strip else out


def segments(text: Column, normal: bool = False) -> Column:
    """array<array<string>>: lower-cased Latin words; white space parts words, anything else segments.
    What follows a summary heading is cut off. With ``normal`` the text is in NFC already."""
    low = F.lower(F.translate(text if normal else nfc(text), "Ðð", "Đđ"))
    cut = F.regexp_replace(low, SUMMARY, "")
    parts = F.transform(F.split(cut, "[^\\p{IsLatin}\\s]+"), lambda s: F.array_remove(F.split(s, "\\s+"), ""))
    return F.filter(parts, lambda p: F.size(p) > 0)


def has_summary(text: Column) -> Column:
    return F.lower(text).rlike(SUMMARY)


def pairs(words: Column) -> Column:
    """Adjacent pairs of an array of words."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def years(text: Column) -> Column:
    """Distinct four-digit years from 1000 to 2999 that stand alone, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?<![\\p{L}\\p{N}_])[12][0-9]{3}(?![\\p{L}\\p{N}_])"), 0), lambda y: y.cast("int"))))


def annotation_text(text: Column) -> Column:
    """NFC without parentheses, white space and punctuation; brackets, quotes and @ stay."""
    return F.regexp_replace(nfc(text), "[()\\s\\x{A0}\\x{3000}]|(?!@)[\\p{Pc}\\p{Pd}\\p{Po}]", "")


def graphemes(text: Column) -> Column:
    """User-perceived characters."""
    return F.regexp_extract_all(text, F.lit("\\X"), 0)


def layout(text: Column, mode: str = "preserve", drop_backslashes: bool = False) -> Column:
    """Line breaks kept, replaced by a space, or removed."""
    t = F.regexp_replace(text, "\\\\", "") if drop_backslashes else text
    if mode == "preserve":
        return t
    return F.regexp_replace(t, "\\s*\\n\\s*", " " if mode == "space" else "")


def font_key(name: Column) -> Column:
    """Font name without subset tag, case and anything but letters and digits."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "^[A-Z]{6}\\+", "")), "[^\\p{L}\\p{N}]", "")


#: Endings of font names that name a style; the first that fits counts.
STYLES = ("bolditalic", "regular", "oblique", "italic", "normal", "bold")


def font_style(name: Column) -> Column:
    """struct(family, style) of a font's name; style is null where the name has no such ending or is nothing else."""
    key = font_key(name)
    style = F.lit(None).cast("string")
    for s in reversed(STYLES):
        style = F.when(F.endswith(key, F.lit(s)) & (key != s), s).otherwise(style)
    return F.struct(F.when(style.isNull(), key).otherwise(F.substring(key, F.lit(1), F.length(key) - F.length(style))).alias("family"), style.alias("style"))


def hex_codes(run: Column) -> Column:
    """16-bit codes of a run of hexadecimal digits; an odd run gives none."""

    def codes(clean: Column) -> Column:
        n = (F.length(clean) / 4).cast("int")
        at = F.when((F.length(clean) % 4 == 0) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: F.conv(F.substring(clean, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))

    # an array of one names the digits, which would be reckoned again for every code
    return F.get(F.transform(F.array(F.regexp_replace(run, "\\s", "")), codes), F.lit(0))


def fingerprint(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def bad_characters(text: Column) -> Column:
    """Whether a text holds U+FFFD, a surrogate, or a control character other than a line break."""
    return text.rlike("[\\x{FFFD}\\p{Cs}]|[\\p{Cc}&&[^\\n]]")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.when(whole != 0, F.round(100 * part / whole, digits))
