"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that rejects a text. Costs and selectivities are measured on a
sample of the rows that reach the rules, in one job; the next rule is always the one with the most rejections per second among what the rules before it
leave, and a text that one rule rejects is not shown to the next. The verdict does not depend on the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the sample is picked from, in expectation, how often a timed rule sees each, and from which time on it counts,
#: when the code has been compiled.
SAMPLE_ROWS, REPEATS, WARM = 1000, 6, 4

#: The white space that ends a word, and symbols.
SPACE, SYMBOLS = "\\x20\\x09-\\x0D", "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an expression over columns text, words (array) and the base statistics."""

    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    """Runs of characters other than space and \\t-\\r, in order; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash occurs twice or more: those windows are sorted with their
    places, and gaps between neighbouring places are summed, three words at most for each."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(placed, lambda p: F.filter(p, lambda x, j: F.get(p, j - 1)["h"].eqNullSafe(x["h"]) | F.get(p, j + 1)["h"].eqNullSafe(x["h"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"))
    return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are told apart by 64-bit hashes;
    only texts with equal ones have them sorted."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    none = F.lit(0).cast("long")
    return F.when(n < 3, none).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_covered(w))))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words (array), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; columns
    of those names are replaced. A null text counts as an empty one."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("words", words_of(t))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("words")),
        }
    )


def default_rules() -> list[Rule]:
    """Rules beyond the base ones; every one errs on the side of keeping a text."""
    words = F.col("words")
    n = F.col("n_words")
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * F.col("word_chars")),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("letters", 2 * F.size(F.filter(words, lambda w: ~w.rlike("\\p{L}"))) > n),
        Rule("exclaiming", 2 * F.size(F.filter(words, lambda w: w.endswith("!!"))) > n),
        Rule("few_distinct", 10 * F.size(F.array_distinct(words)) < n),
        Rule("shouting", F.expr("2 * size(filter(words, w -> length(w) > 1 and w = upper(w) and w <> lower(w)))") > n),
    ]


def greedy(patterns: list[tuple[tuple[bool, ...], int]], cost: list[float]) -> list[int]:
    """The order of rules: next is the one that rejects most rows per second of those that none before it rejects; of
    equal ones the cheaper, then the earlier. patterns: which rules reject, and rows of that kind."""
    todo, out = list(range(len(cost))), []
    while todo:
        got = {i: sum(n for hit, n in patterns if hit[i]) for i in todo}
        best = min(todo, key=lambda i: (-got[i] / cost[i], cost[i], i))
        patterns = [(hit, n) for hit, n in patterns if not hit[best]]
        todo.remove(best)
        out.append(best)
    return out


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, key: str = "doc_id") -> list[Rule]:
    """Rules in the order of ``greedy``, by their rejections and costs on the rows of a sample that don't fail the base rule, since only those
    reach them. The sample is of about ``rows`` rows, picked by a hash of the key from the whole table; docs must have the
    columns of ``base_statistics``. One job does it: the clock is read between the rules of each row."""
    rules = sorted(rules, key=lambda r: r.name)
    if not rules:
        return rules
    share = min(1.0, rows / max(1, docs.select(key).count()))
    even = F.shiftrightunsigned(F.xxhash64(F.lit("rules"), F.col(key)), 11) / F.lit(float(1 << 53))
    # kept, so that the statistics are columns and not expressions inside the filter and the rules
    sample = docs.where(even < share).persist()
    copies = sample.where(~base_failed()).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    clock = F.call_function("reflect", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    # fields of a struct are evaluated in order; the copy's number keeps a rule from being evaluated once for all copies
    steps = [clock.alias("t0")]
    for i, r in enumerate(rules):
        steps += [(F.coalesce(r.rejects, F.lit(False)) & (F.col("__copy") > 0)).alias(f"r{i}"), clock.alias(f"t{i + 1}")]
    timed = copies.select("__copy", F.struct(*steps).alias("m"))
    spent = [F.sum(F.when(F.col("__copy") >= WARM, F.col(f"m.t{i + 1}") - F.col(f"m.t{i}")).otherwise(0)).alias(f"c{i}") for i in range(len(rules))]
    seen = timed.groupBy(*[F.col(f"m.r{i}").alias(f"r{i}") for i in range(len(rules))]).agg(F.count_if(F.col("__copy") == 1).alias("n"), *spent).collect()
    sample.unpersist()
    cost = [max(float(sum(r[f"c{i}"] for r in seen)), 1.0) for i in range(len(rules))]
    return [rules[i] for i in greedy([(tuple(r[: len(rules)]), r["n"]) for r in seen], cost)]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated then."""
    out = None
    for r in rules:
        hit = F.coalesce(r.rejects, F.lit(False))
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: neither
    that nor any rule rejects. Null and empty texts have zero counts and fail. Repeated rows are each
    returned; other columns are ignored; an empty table gives an empty result."""
    base = base_statistics(docs.select(F.col(key), F.col(text).cast("string").alias("text")))
    rules = order_rules(base, default_rules() if rules is None else rules, key=key)
    kept = F.when(base_failed(), F.lit(False)).otherwise(cascade(rules).isNull())
    return base.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
