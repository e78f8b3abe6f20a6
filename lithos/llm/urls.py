"""URL verdicts: listed rules first, else logistic regression on hashed character n-grams.

The classifier is trained on the driver, once a process, from a small labelled table of URLs that a rule makes of the words of
some topics. Of a path only its words count, so the pages of a host have one verdict unless their words differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import U, SpanHasher, slices

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)

#: Words of unwanted pages and of others, by topic. ``labelled`` makes the table out of them.
UNWANTED = {
    "gambling": "casino poker betting slots lottery jackpot roulette spins bingo gambling bonus wager",
    "pills": "pills viagra cialis pharmacy meds steroids dosage cheap generic prescription",
    "adult": "adult porn xxx cams escort dating singles nude erotic hotties",
    "scams": "prize winner payday loans doubler miracle millionaire giveaway riches claim",
    "piracy": "warez crack keygen torrent nulled serial cracked unlocked",
    "advertising": "adserver tracker popup banner clicks pixel popunder affiliate",
    "farms": "spam backlinks linkbuilding doorway autoblog spinner clickbait replica",
}
WANTED = {
    "learning": "university library school science history lecture course research museum archive",
    "nature": "garden mountain river forest weather animal flower island botany climate",
    "kitchen": "recipes cooking bakery bread coffee vegetable kitchen dinner cheese orange",
    "arts": "theater orchestra painting poetry sculpture gallery concert novel ballet photography",
    "trades": "engineer builder carpenter mechanic electrician farmer tailor plumber workshop tools",
    "health": "hospital doctor nurse clinic dentist patient therapy medicine fitness wellness",
    "town": "council station harbor bridge market street parking mayor district townhall",
    "travel": "travel airport railway bicycle hotel tourism camping ferry passport guide",
    "software": "software developer manual network database compiler server release tutorial github",
    "news": "newspaper journal editor report weekly magazine opinion politics economy interview",
}
#: How words stand in hosts and paths, and ends of hosts.
HOSTS = ("{0}.{e}", "{0}-{1}.{e}", "www.{0}{1}.{e}", "{1}.{0}.{e}", "the{0}.{e}", "my-{0}-{1}.{e}", "{0}online.{e}", "blog.{0}{1}.{e}")
PATHS = ("/", "/{2}", "/{2}/{3}.html", "/{2}-{3}", "/{1}/{2}", "/page/{3}", "/{3}?id=7")
ENDS = ("com", "net", "org", "info", "co.uk", "io", "example")


def labelled(rounds: int = 3) -> list[tuple[str, int, tuple[str, ...]]]:
    """A small labelled table: URL, 1 where it is unwanted, and the words that stand in it. A URL has up to four words of one topic; each word
    comes first in ``rounds`` hosts. Hosts, ends and paths go round alike for both labels, so they tell nothing."""
    out, n = [], 0
    for label, topics in ((1, UNWANTED), (0, WANTED)):
        for words in map(str.split, topics.values()):
            for i, _ in enumerate(words):
                for j in range(rounds):
                    four = [words[(i + k * (j + 1) + k) % len(words)] for k in range(4)]
                    form = HOSTS[n % len(HOSTS)].replace("{e}", ENDS[n // 2 % len(ENDS)]) + PATHS[n // 3 % len(PATHS)]
                    used = tuple(w for k, w in enumerate(four) if f"{{{k}}}" in form)
                    out.append((f"http://{form.format(*four)}", label, used))
                    n += 1
    return out


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with its subdomains and a beginning of the path; ``text`` is host + path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, or null; of equally long ones the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


# ---------------------------------------------------------------- classifier


def _grams(array: pa.Array):
    """(row, bucket) of the n-grams of each string, which is held between two marks."""
    rows, hits = [], []
    for s in slices(array):
        h = SpanHasher(s.data)
        n = np.diff(s.starts)
        for k in ORDERS:
            count = np.maximum(n - k + 1, 0)
            row = np.repeat(np.arange(s.rows), count)
            at = np.repeat(s.starts[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            rows.append(row + s.first)
            hits.append(((h(at, at + k) >> U(37)) & U(BUCKETS - 1)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(hits)) if rows else (np.empty(0, int), np.empty(0, int))


@dataclass
class UrlModel:
    weight: np.ndarray
    bias: float


def marked(host: Column, path: Column) -> Column:
    """Host and the words of the path (four letters or more in a row, A-Z lower-cased, without ``html``) as one string."""
    lower = F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.regexp_extract_all(lower, F.lit("[a-z]{4,}"), 0), lambda w: w != "html")
    return F.concat(F.lit("^"), host, F.lit("$"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("/"), w)), ""), F.lit("$"))


def _marked(url: str) -> str:
    host, slash, path = url.partition("://")[2].partition("/")
    words = [w for w in re.findall("[a-z]{4,}", (slash + path).partition("?")[0].partition("#")[0].lower()) if w != "html"]
    return f"^{host.lower()}${''.join('/' + w for w in words)}$"


@cache
def default_model() -> UrlModel:
    """Trained on the whole of ``labelled``, once a process."""
    return train_urls([(u, y) for u, y, _ in labelled()])


def train_urls(table: list[tuple[str, int]], steps: int = 1500) -> UrlModel:
    """Full-batch gradient descent with a ridge. An n-gram weighs less the more rows of the table hold
    it, so that what most hosts share tells little."""
    x, t = _vectors(pa.array([_marked(u) for u, _ in table], pa.string())), np.array([y for _, y in table], float)
    rare = np.log1p(len(t) / np.maximum((x > 0).sum(0), 1)) ** 2 / 8
    x *= rare
    # the weights are sums of rows of x, so the descent runs on one coefficient a row
    k, c, b = x @ x.T, np.zeros(len(t)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(k @ c + b)))
        c -= 4.0 * ((p - t) / len(t) + 2e-4 * c)
        b -= 1.0 * (p - t).mean()
    w = x.T @ c
    return UrlModel(w * rare, float(b))


def _vectors(array: pa.Array) -> np.ndarray:
    row, hit = _grams(array)
    x = np.zeros((len(array), BUCKETS))
    np.add.at(x, (row, hit), 1)
    x = np.minimum(x, 1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def url_scores(model: UrlModel, array: pa.Array) -> np.ndarray:
    """Probability that a marked string is unwanted."""
    row, hit = _grams(array)
    pair = np.unique(row * BUCKETS + hit)
    row, hit = pair // BUCKETS, pair % BUCKETS
    n = np.bincount(row, minlength=len(array))
    z = np.bincount(row, weights=model.weight[hit], minlength=len(array)) / np.sqrt(np.maximum(n, 1)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def judge_urls(pages: DataFrame, rules: list[UrlRule], model: UrlModel | None = None, key: str = "page_id", url: str = "url", least: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row: the rule's verdict where one fits, else
    ``block`` where the model's score is ``least`` or more. A null url and one without :// have empty
    host and path, fit no rule and are allowed with score 0. Only key and url are read; repeated rows
    are each judged; an empty table gives an empty result."""
    model = model or default_model()
    base = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("marked", marked(F.col("host"), F.col("path")))

    def run(batches):
        for b in batches:
            score = url_scores(model, b.column("marked"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    kind = base.schema["key"].dataType.simpleString()
    scored = base.mapInArrow(run, f"key {kind}, host string, path string, rule string, score double")
    scored = scored.withColumn("score", F.when((F.col("host") == "") & (F.col("path") == ""), 0.0).otherwise(F.col("score")))
    said = F.when(F.col("score") >= least, "block").otherwise("allow")
    for r in rules:
        said = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(said)
    return scored.select(F.col("key").alias(key), "host", "path", "rule", said.alias("verdict"), "score")
