"""Source divergence audit: how far each source's words lie from those of the other sources of its language.

Terms are counted once, inside the tasks, as rows (lang, source, term, count). All terms of a language with
the same sparse vector of source counts are one distinct vector with a multiplicity, and a pair of sources is
evaluated once per distinct vector. Of a pair only the vectors that hold both sources are looked at: with f(a, b)
the divergence of counts a and b,

    sum f(a, b) = V f(0, 0) + sum [f(a, 0) - f(0, 0)] + sum [f(0, b) - f(0, 0)]
                  + sum over a, b > 0 of [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)],

where the second and third sums need only how many terms a source has with each count. Work so follows
what occurs, not terms x sources x sources. All arithmetic is on integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .tokens import _LOWER, batch_of, runs, slices

#: Fixed value: probabilities are counted in parts of this many.
UNIT = 1_000_000_000
#: Bytes of text that are counted at once, and lots of a group's terms that are ranked by themselves first.
SLICE, LOTS = 4 << 20, 16

#: Bytes of a term, ASCII letters and all of UTF-8 beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of (lang, source, text): occurrences and documents."""
    for batch in batches:
        group = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        for s in slices(batch.column(2), SLICE):
            data = _LOWER[s.data]
            inside = _TERM[data]
            start, end, first = runs(inside, s.starts)
            if not len(start):
                continue
            offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
            found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
            size = len(found.dictionary)
            row = np.repeat(np.arange(s.rows), np.diff(first))
            each, n = np.unique(row * size + found.indices.to_numpy(), return_counts=True)
            names = group.slice(s.first, s.rows)
            code = pa.array([f"{len(x['lang'])} {x['lang']}{x['source']}" for x in names.to_pylist()]).dictionary_encode().indices.to_numpy().astype(np.int64)
            firsts = np.unique(code, return_index=True)[1]
            both, back = np.unique(code[each // size] * size + each % size, return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, back, n)
            head = names.take(pa.array(firsts[both // size]))
            yield batch_of(_COUNTS, [head.field(0), head.field(1), found.dictionary.take(pa.array(both % size)), total, np.bincount(back)])


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); decimals, since the product may pass 64 bits."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + terms).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: item is each other source of the language and value the sum of f over the language's kept terms.
    Part ``term``: item is each of the ``top`` kept terms that stand out in the source against its language.
    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those of at least
    ``min_docs`` of its documents, a document being a row (a repeated row counts again). Null lang, source and text
    are ''; a language without kept terms has pairs of value 0. Equal values rank by item in UTF-8 order. Other
    columns are ignored; an empty table gives no rows."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    texts = docs.select(c(lang).alias("lang"), c(source).alias("source"), c(text).alias("text"))
    counted = texts.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a kept term with its sparse vector; at most one entry a source
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec")
    terms = cut(counted.groupBy("lang", "term").agg(vector, F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))

    entries = terms.select("lang", "term", "all", F.explode("vec").alias("e")).select("lang", "term", "all", "e.source", "e.n")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_n"))
    groups = (
        texts.groupBy("lang", "source").agg(F.lit(1).alias("x"))
        .join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("total", "terms", "lang_n")])
    )
    zero = F.lit(0).cast("long")
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))))
    p = share(F.col("n"), F.col("total"), F.col("terms"))

    pairs = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair_part = _pairs(terms, entries, groups, p).select("lang", "source", F.lit("pair").alias("part"), "item", "value", pairs.alias("rank"))

    q = share(F.col("all"), F.col("lang_n"), F.col("terms"))
    out = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    out = out.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    # the best of each lot, then the best of those: no task ranks all terms of a large group
    lot = F.row_number().over(Window.partitionBy("lang", "source", "lot").orderBy(F.desc("value"), "item"))
    best = out.withColumn("lot", F.pmod(F.xxhash64("item"), F.lit(LOTS))).withColumn("at", lot).where(F.col("at") <= top)
    term_part = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", pairs.alias("rank")).where(F.col("rank") <= top)
    return pair_part.unionByName(term_part)


def _pairs(terms: DataFrame, entries: DataFrame, groups: DataFrame, p: Column) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    # distinct vectors; their numbers hold because the table is written
    distinct = cut(terms.groupBy("lang", "vec").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()))
    known = distinct.select("id", "lang", "times", F.explode("vec").alias("e")).select("id", "lang", "times", "e.source", "e.n").join(groups, ["lang", "source"])
    rows = known.select("id", "lang", "times", F.struct("source", p.alias("p"), "p0").alias("e")).groupBy("id", "lang", "times").agg(F.collect_list("e").alias("vec"))
    both = rows.select("lang", "times", "vec", F.explode("vec").alias("a")).select("lang", "times", "a", F.explode("vec").alias("b")).where("a.source <> b.source")
    a, b = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    change = distance(a("p"), b("p")) - distance(a("p"), b("p0")) - distance(a("p0"), b("p")) + distance(a("p0"), b("p0"))
    shared = both.select("lang", a("source").alias("source"), b("source").alias("item"), (F.col("times") * change).alias("value"))
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # how many terms a source has with each count, against every other source as if without them
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    counts = entries.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"]).select("lang", "source", "times", p.alias("p"), "p0")
    met = counts.join(other, "lang").where("source <> other")
    p_, p0, o0, times = (F.col(x) for x in ("p", "p0", "o0", "times"))
    sides = F.array(
        F.struct(F.col("source"), F.col("other").alias("item"), (times * (distance(p_, o0) - distance(p0, o0))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (times * (distance(o0, p_) - distance(o0, p0))).alias("value")),
    )
    alone = met.select("lang", F.explode(sides).alias("e")).select("lang", "e.*").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    none = F.coalesce(F.col("terms") * distance(F.col("p0"), F.col("o0")), F.lit(0)).alias("value")
    base = groups.join(other, "lang").where("source <> other").select("lang", "source", F.col("other").alias("item"), none)
    return base.unionByName(alone).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
