"""Secret scan: fixed patterns, and a randomness battery for strings that no pattern knows.

DataFrame expressions only. Strings of 20 signs or more get an encoding from the signs they hold. The battery
asks whether a string can be drawn at random from that alphabet: chi-squared uniformity, over all signs by
the exact distribution of equal pairs and over a few pooled cells (digits, vowels, common and other consonants,
capitals), where short strings have power too; runs about the middle of the alphabet, which are binomial; and
serial correlation, by its moments over all orders. Simes' rule, which holds for positively dependent tests,
makes one p-value of the four. Benjamini-Hochberg within each length class, on counts of p-values over the
whole corpus, tells which strings are not random; of those it drops, at most FALSE_SHARE are random ones in
expectation, whatever the length. What is left is a finding.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: The patterns of each kind, in the order in which kinds are listed.
ASSIGN_HEAD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

#: Strings that the battery looks at, and fixed alphabets.
STRING = "[A-Za-z0-9+/_-]{20,}={0,2}"
SIGNS = {
    "base16": "0123456789ABCDEF",
    "base16l": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36l": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Pooled cells: digits, vowels, the consonants that text has most of; what is in none is one more.
DIGITS, VOWELS, COMMON, CAPITALS = "0123456789", "aeiou", "tnshrdlcm", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Random strings among those that Benjamini-Hochberg drops; bins of -log10 p; lengths that open a class; the
#: greatest length with exact tables.
FALSE_SHARE, BIN, MOST_BINS = 0.05, 0.05, 400
CLASSES = (20, 24, 32, 48, 64)
EXACT = 64
TESTS = ("p_uniform", "p_pooled", "p_runs", "p_serial")


def _spans(text: Column, pattern: str, maybe: Column, kind: str) -> Column:
    """array<struct<start, kind, end, body>> of the leftmost non-overlapping matches, in code points.
    Each search takes the gap before a match along, so that lengths add up to places; texts for which
    ``maybe`` is false are not searched."""
    search = F.lit(f"\\G(?s)(.*?)({pattern})")  # \\G: what follows the last match is searched once
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, body: string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a, x):
        lo = a["at"] + F.length(x["gap"])
        hi = lo + F.length(x["body"])
        one = F.struct(lo.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), hi.alias("end"), x["body"].alias("body"))
        return F.struct(hi.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    both = F.arrays_zip(F.regexp_extract_all(text, search, 1).alias("gap"), F.regexp_extract_all(text, search, 2).alias("body"))
    both = F.transform(both, lambda x: F.struct(x["gap"].alias("gap"), x["body"].alias("body")))
    return F.when(maybe, F.aggregate(both, start, step, lambda a: a["out"])).otherwise(empty)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the three base kinds; text must not be null."""
    assign = _spans(text, ASSIGN, (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN_HEAD), "assign")
    assign = F.filter(assign, lambda s: F.length(F.regexp_replace(s["body"], "^" + ASSIGN_HEAD, "")) >= LEAST["assign"])
    access = _spans(text, ACCESS, F.contains(text, F.lit("AKIA")), "access")
    access = F.filter(access, lambda s: F.length(s["body"]) >= LEAST["access"])
    # a run of HEX is maximal, so runs of at least so many are those that don't fail
    return assign, access, _spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"), "hex")


def render(spans: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, within some per cent."""
    y = F.abs(z)
    up = 2 * F.exp(-y * y / 2) / ((y + F.sqrt(y * y + 2.546)) * 2.5066)
    return F.greatest(F.when(z >= 0, up).otherwise(1 - up), F.lit(1e-300))


@lru_cache(maxsize=8)
def equal_pairs(k: int) -> list[list[float]]:
    """For n up to EXACT signs drawn evenly from k, the chance of c equal pairs or more, at [n][c], up to where it vanishes."""
    most = EXACT * EXACT // (2 * k) + 12 * int((EXACT * EXACT / (2 * k)) ** 0.5) + 30
    # ways[n, c] / n!: signs are added one by one, j copies of each
    ways = np.zeros((EXACT + 1, most + 1))
    ways[0, 0] = 1.0
    for _ in range(k):
        new, fact = ways.copy(), 1.0
        for j in range(1, EXACT + 1):
            fact *= j
            c = j * (j - 1) // 2
            if c > most:
                break
            new[j:, c:] += ways[: EXACT + 1 - j, : most + 1 - c] / fact
        ways = new / k  # so that no entry grows beyond 1 by much
    out = []
    for n in range(EXACT + 1):
        p = ways[n] / max(ways[n].sum(), 1e-300)
        tail = np.cumsum(p[::-1])[::-1]
        out.append([float(f"{x:.6g}") for x in tail[: int((tail > 1e-15).sum())]])
    return out


@lru_cache(maxsize=1)
def binomial_runs() -> list[list[float]]:
    """For n up to EXACT fair signs, the two-sided p-value of r runs, at [n][r]: changes are binomial."""
    out: list[list[float]] = [[1.0], [1.0, 1.0]]
    for n in range(2, EXACT + 1):
        p = np.ones(1)
        for _ in range(n - 1):
            p = (np.append(p, 0) + np.insert(p, 0, 0)) / 2
        low, high = np.cumsum(p), np.cumsum(p[::-1])[::-1]
        out.append([1.0, *[float(f"{x:.6g}") for x in np.minimum(1, 2 * np.minimum(low, high))]])
    return out


def _cells(code: str) -> list[str]:
    """The signs of each pooled cell."""
    signs = SIGNS[code]
    if code.startswith("base16"):
        parts = [DIGITS]
    elif code == "base64":
        parts = [DIGITS, VOWELS, COMMON, CAPITALS]
    else:
        parts = [DIGITS, *([VOWELS, COMMON] if code.endswith("l") else [VOWELS.upper(), COMMON.upper()])]
    parts = ["".join(c for c in p if c in signs) for p in parts]
    return [*parts, "".join(c for c in signs if not any(c in p for p in parts))]


def _constant(values: list, kind: str) -> Column:
    """Values as one literal, however many; F.lit makes an expression of each."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def battery(strings: DataFrame) -> DataFrame:
    """strings(…, body) with encoding, n, p_uniform, p_pooled, p_runs, p_serial and p, which Simes' rule makes of them. All
    are p-values of a string of signs drawn evenly and independently; rows whose signs fit no encoding (without a
    digit or a letter, or of mixed kinds without capitals) are left out."""
    df = strings.withColumn("__b", F.translate(F.regexp_replace(F.col("body"), "=+$", ""), "-_", "+/"))
    has = lambda p: F.col("__b").rlike(p)
    both = has("[0-9]") & has("[A-Za-z]")
    code = (
        F.when(~both, None)
        .when(has("^[0-9A-F]+$"), "base16").when(has("^[0-9a-f]+$"), "base16l").when(has("^[A-Z2-7]+$"), "base32")
        .when(has("^[A-Z0-9]+$"), "base36").when(has("^[a-z0-9]+$"), "base36l").when(has("[a-z]") & has("[A-Z]"), "base64")
    )
    df = df.withColumn("encoding", code).where("encoding is not null").withColumn("n", F.length("__b"))
    # whatever differs by encoding is looked up at its place among SIGNS
    df = df.withColumn("__e", F.array_position(F.array(*[F.lit(e) for e in SIGNS]), F.col("encoding")).cast("int") - 1)
    of = lambda values, kind: F.get(_constant(values, f"array<{kind}>"), F.col("__e"))
    df = df.withColumn("__a", of(list(SIGNS.values()), "string")).withColumn("__k", F.length("__a").cast("double"))
    df = df.withColumn("__v", F.transform(F.regexp_extract_all("__b", F.lit("."), F.lit(0)), lambda c: F.instr(F.col("__a"), c).cast("double")))
    n, k, v = F.col("n").cast("double"), F.col("__k"), F.col("__v")

    # equal pairs: k / n * (2 * pairs + n) - n is the chi-squared statistic over all signs
    held = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
    df = df.withColumn("pairs", ((held - n) / 2).cast("int"))
    pairs = F.col("pairs")
    mean = n * (n - 1) / (2 * k)
    far = _tail((pairs - 0.5 - mean) / F.sqrt(mean * (1 - 1 / k)))
    exact = F.get(F.get(of([equal_pairs(len(a)) for a in SIGNS.values()], "array<array<double>>"), F.col("n")), pairs)
    p_uniform = F.when(n > EXACT, far).otherwise(F.coalesce(exact, F.lit(1e-15)))

    # observed and wanted signs of each pooled cell; one degree of freedom is a squared normal, more go by the cube root
    df = df.withColumn("__c", F.transform(of([_cells(e) for e in SIGNS], "array<string>"), lambda c: F.struct((n - F.length(F.call_function("translate", F.col("__b"), c, F.lit("")))).alias("o"), (n * F.length(c) / k).alias("w"))))
    df = df.withColumn("pooled", F.aggregate("__c", F.lit(0.0), lambda a, c: a + (c["o"] - c["w"]) * (c["o"] - c["w"]) / c["w"])).withColumn("__f", F.size("__c") - 1)
    stat, free = F.col("pooled"), F.col("__f")
    p_pooled = F.when(free == 1, 2 * _tail(F.sqrt(stat))).otherwise(_tail((F.cbrt(stat / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))))

    df = df.withColumn("__h", F.transform(v, lambda x: x > k / 2))
    h = F.col("__h")
    df = df.withColumn("runs", 1 + F.size(F.filter(h, lambda x, i: (i > 0) & (x != F.get(h, i - 1)))))
    off = F.greatest(F.abs(F.col("runs") - 1 - (n - 1) / 2) - 0.5, F.lit(0.0))
    p_runs = F.when(n > EXACT, 2 * _tail(off / (F.sqrt(n - 1) / 2))).otherwise(F.get(F.get(_constant(binomial_runs(), "array<array<double>>"), F.col("n")), F.col("runs")))

    df = df.withColumn("__m", F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n)
    df = df.withColumn("__d", F.transform(v, lambda x: x - F.col("__m")))
    d = F.col("__d")
    df = df.withColumn("__s2", F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)).withColumn("__s4", F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x * x * x))
    df = df.withColumn("lag", F.aggregate(F.transform(d, lambda x, i: F.when(i > 0, x * F.get(d, i - 1)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
    s2, s4 = F.col("__s2"), F.col("__s4")
    spread = (s2 * s2 - s4) / n + (s2 * s2 - 2 * s4) / (n * (n - 1)) - s2 * s2 / (n * n)
    p_serial = F.when(spread > 0, 2 * _tail(F.abs((F.col("lag") + s2 / n) / F.sqrt(spread)))).otherwise(F.lit(1e-300))

    df = df.withColumns({"p_uniform": p_uniform, "p_pooled": p_pooled, "p_runs": p_runs, "p_serial": p_serial})
    df = df.withColumns({c: F.least(F.col(c), F.lit(1.0)) for c in TESTS})
    ordered = F.array_sort(F.array(*[F.col(c) for c in TESTS]))
    simes = F.array_min(F.transform(ordered, lambda x, i: x * len(TESTS) / (i + 1)))
    return df.withColumn("p", F.greatest(F.least(simes, F.lit(1.0)), F.lit(1e-300))).drop("__b", "__e", "__a", "__k", "__v", "__c", "__f", "__h", "__m", "__d", "__s2", "__s4")


def discoveries(tested: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """The strings that are left after Benjamini-Hochberg at ``share`` on p, within their length class, has dropped those
    that are not random. Only counts of binned p-values go to the driver: length classes times bins."""
    size = F.col("n")
    group = F.lit(0)
    for i, x in enumerate(CLASSES):
        group = F.when(size >= x, F.lit(i)).otherwise(group)
    binned = tested.withColumn("__g", group).withColumn("__p", F.least(F.floor(-F.log10("p") / BIN), F.lit(MOST_BINS)).cast("int"))
    counts: dict[int, dict[int, int]] = {}
    for r in binned.groupBy("__g", "__p").agg(F.count("*").alias("c")).collect():
        counts.setdefault(r["__g"], {})[r["__p"]] = r.c
    keep = F.lit(True)
    for g, bins in counts.items():
        m, seen, cutoff = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10.0 ** (-b * BIN) <= share * seen / m:  # the greatest p-value of the bin
                cutoff = b
        if cutoff is not None:
            keep = keep & ~((F.col("__g") == g) & (F.col("__p") >= cutoff))
    return binned.where(keep).drop("__g", "__p")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row. spans: the base spans, and as
    ``random`` the battery's discoveries that overlap none of them. A null text counts as an empty
    one; without spans the strings are empty. Repeated rows are each returned; other columns are
    ignored; an empty table gives an empty result."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), t).alias("rid"), t.alias("text"))
    assign, access, hexes = base_spans(F.col("text"))
    strings = _spans(F.col("text"), STRING, F.col("text").rlike(STRING), "random")
    strings = F.filter(strings, lambda s: s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]"))
    found = cut(
        base.select("key", "rid", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), strings.alias("strings"))
        .withColumn("base", F.array_sort(F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))) for c in ("assign", "access", "hex")])))
        .select("key", "rid", F.size("assign").alias("n_assign"), F.size("access").alias("n_access"), F.size("hex").alias("n_hex"), "base", "strings")
        .withColumn("strings", F.filter("strings", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    )
    each = found.where(F.size("strings") > 0).dropDuplicates(["rid"]).select("rid", F.explode("strings").alias("s")).select("rid", "s.start", "s.kind", "s.end", "s.body")
    tested = cut(battery(each))
    more = discoveries(tested).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    return found.join(more, "rid", "left").select(
        F.col("key").alias(key),
        *[F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(render(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        render(F.concat("base", F.coalesce("more", none))).alias("spans"),
    )
