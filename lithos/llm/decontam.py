"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of the item's own length slide over the texts. Window and item have
64-bit SimHash fingerprints of their weighted shingles. A multi-index of four 16-bit blocks finds every
window within RADIUS bits of an item: two fingerprints that near agree up to RADIUS // 4 bits on some
block, and the index of a block leads from each value to the items that near. Candidates are compared
exactly by weighted Jaccard similarity of their shingle multisets.

A window of similarity t shares weight t of its item's weight, so it shares one of the item's rarest
shingles that hold more than 1 - t of it. Postings of those shingles alone tell which items a text may hold,
and only these are fingerprinted and indexed for that text: the work does not grow with the items that
have nothing to do with it. Items are held in blocks of bounded weight. A benchmark of several blocks first
reduces the texts to those that hold a known shingle at all, by a bit table of bounded size, in one scan;
the passes of the blocks run over what is left, each block leaving the driver before the next is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import U, SpanHasher, batch_of, mix, points, shingle_hash, slices, tokens

#: Bits within which all fingerprints are found. A pair of similarity 0.8 differs in 9.6 of 64 bits on
#: average, with a deviation of 2.9, so 19 leaves out under one such pair in a thousand.
RADIUS = 19
BLOCKS = 4
#: Words of the items of one pass over the texts, and the words of the longest item that is indexed
#: by one window; longer items are indexed by consecutive windows of that size, the last of which ends with the item.
PASS_WORDS, ITEM_WORDS = 500_000, 4096
#: Greatest bits of the table of all known shingles; windows that are fingerprinted at once; items of one index.
TABLE_BITS, STEP, INDEXED = 1 << 30, 1 << 14, 64


@dataclass
class Items:
    """The items of one pass. Shingles of item i: shingle[at[i]:at[i+1]], sorted, with counts."""

    ids: np.ndarray
    size: np.ndarray  # words
    shingle: np.ndarray
    count: np.ndarray
    at: np.ndarray
    rare: float  # weight of a shingle that no item holds
    known: np.ndarray  # sorted shingles of all items, their weights and the items that hold each
    weight: np.ndarray
    df: np.ndarray
    print_: np.ndarray  # fingerprints
    k: int
    place: np.ndarray  # of each of ``shingle`` in ``known``
    index: dict = field(default_factory=dict)


def weigh(items: Items, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(items.known, h)
    at[at == len(items.known)] = 0
    return np.where(items.known[at] == h, items.weight[at], items.rare) if len(items.known) else np.full(len(h), items.rare)


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1


def _pack(v: np.ndarray) -> np.ndarray:
    return np.packbits(v > 0, axis=1).view(U).reshape(-1)


def _exact(w):
    """Weights as multiples of 1/1024: running sums of them are exact, so equal windows have equal prints."""
    return np.round(w * 1024) / 1024


def build(ids: list[int], texts: list[str], k: int = 5) -> Items:
    """Items with no word are left out; long ones are cut into windows of ITEM_WORDS words."""
    keep, size, per = [], [], []
    for s in slices(pa.array(texts, pa.string())):
        w = tokens(s)
        h, at = shingle_hash(SpanHasher(w.data)(w.start, w.end), w.first, k)
        for i in range(s.rows):
            n = int(w.count[i])
            starts = [*range(0, n - ITEM_WORDS, ITEM_WORDS), max(0, n - ITEM_WORDS)] if n else []
            for x in starts:
                m = min(n, ITEM_WORDS)
                keep.append(ids[s.first + i])
                size.append(m)
                per.append(h[at[i] + x : at[i] + x + max(1, m - k + 1)])
    uniq = [np.unique(x, return_counts=True) for x in per]
    flat = np.concatenate([u for u, _ in uniq]) if uniq else np.empty(0, U)
    known, df = np.unique(flat, return_counts=True)
    n = max(1, len(per))
    weight = _exact(np.log1p(n / np.maximum(df, 1)))
    counts = np.concatenate([c for _, c in uniq]) if uniq else np.empty(0, int)
    at = np.concatenate([[0], np.cumsum([len(u) for u, _ in uniq])]).astype(int)
    items = Items(np.array(keep, np.int64), np.array(size, np.int64), flat, counts, at, float(_exact(np.log1p(n))), known, weight, df, np.empty(0, U), k, np.searchsorted(known, flat))
    items.print_ = np.array([_pack((_bits(mix(u)) * (weigh(items, u) * c)[:, None]).sum(0, keepdims=True))[0] for u, c in uniq], U)
    return items


def _around() -> np.ndarray:
    """All 16-bit values with at most RADIUS // BLOCKS bits set."""
    v = np.arange(1 << 16)
    return v[np.bitwise_count(v) <= RADIUS // BLOCKS]


def _postings(items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, index of each known shingle's first, weight of each of ``shingle`` in its item, weight of each item). Of
    each item the rarest shingles are listed whose weight is just over 1 - least of it."""
    if ("rare", least) not in items.index:
        n = len(items.ids)
        part = items.count * items.weight[items.place]
        owner = np.repeat(np.arange(n), np.diff(items.at))
        total = np.bincount(owner, weights=part, minlength=n)
        order = np.lexsort((items.place, items.df[items.place], owner))
        before = np.cumsum(part[order]) - part[order]
        before -= before[items.at[:-1]][owner]  # owners stand in their order
        listed = order[before <= (1 - least) * total[owner] + 1e-6]
        listed = listed[np.argsort(items.place[listed], kind="stable")]
        items.index["rare", least] = owner[listed], np.searchsorted(items.place[listed], np.arange(len(items.known) + 1)), part, total
    return items.index["rare", least]


def _flat(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of rows in a list of lists, and how many each row has."""
    n = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


def _live(items: Items, held: np.ndarray, least: float) -> np.ndarray:
    """Items of which the known shingles ``held`` (distinct places) hold ``least`` of the weight."""
    lists, first, part, total = _postings(items, least)
    some = np.unique(lists[_flat(first, held)[0]])
    if not len(some):
        return some
    at, n = _flat(items.at, some)
    there = held[np.minimum(np.searchsorted(held, items.place[at]), len(held) - 1)] == items.place[at]
    shared = np.bincount(np.repeat(np.arange(len(some)), n), weights=np.where(there, part[at], 0), minlength=len(some))
    return some[shared >= least * total[some] - 1e-6]


class Index:
    """The multi-index: for each block, from its 65536 values to the items (bits of a word) that near."""

    BALL = _around()

    def __init__(self):
        self.table = np.zeros((BLOCKS, 1 << 16), U)
        self.prints: list[int] = []

    def fill(self, prints: np.ndarray) -> None:
        for v in self.prints:
            for b in range(BLOCKS):
                self.table[b, self.BALL ^ ((v >> 16 * b) & 0xFFFF)] = 0
        self.prints = [int(v) for v in prints]
        for j, v in enumerate(self.prints):
            for b in range(BLOCKS):
                self.table[b, self.BALL ^ ((v >> 16 * b) & 0xFFFF)] |= U(1 << j)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, rows of prints within RADIUS bits of it)."""
        got = np.zeros(len(prints), U)
        for b in range(BLOCKS):
            got |= self.table[b, ((prints >> U(16 * b)) & U(0xFFFF)).astype(np.int64)]
        for j, v in enumerate(self.prints):
            rows = np.flatnonzero(got & U(1 << j))
            yield j, rows[np.bitwise_count(prints[rows] ^ U(v)) <= RADIUS]


def similarity(items: Items, i: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item's and a window's shingle multisets."""
    u, c = np.unique(window, return_counts=True)
    su, sc = items.shingle[items.at[i] : items.at[i + 1]], items.count[items.at[i] : items.at[i + 1]]
    every = np.union1d(u, su)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, u)] = c
    b[np.searchsorted(every, su)] = sc
    w = weigh(items, every)
    return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())


def match(items: Items, n: int, sh: np.ndarray, hit: np.ndarray, place: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """Of one text of n words: (item row, similarity, first word, end word), the best window of each item.
    sh: shingle hashes; hit: positions of shingles that some item holds; place: which of the known ones they are."""
    k, out = items.k, {}
    live = _live(items, np.unique(place), least)
    live = live[(items.size[live] >= k) | (items.size[live] == n)]  # an item of under k words is one shingle, of a whole text only
    index = items.index.setdefault("blocks", Index())
    for size in np.unique(items.size[live]):
        span = min(len(sh), max(1, int(size) - k + 1))  # shingles of a window; a text shorter than the item is one
        same = live[items.size[live] == size]
        for lo in range(0, len(same), INDEXED):
            rows = same[lo : lo + INDEXED]
            index.fill(items.print_[rows])
            own = hit[np.isin(place, items.place[_flat(items.at, rows)[0]])]
            for x, y in _starts(own, span, len(sh)):
                part = sh[x : y + span]
                sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_bits(mix(part)) * weigh(items, part)[:, None], axis=0)])
                for j, found in index.near(_pack(sums[span:] - sums[:-span])):
                    i = int(rows[j])
                    for p in found:
                        sim = similarity(items, i, part[p : p + span])
                        if sim >= least and (i not in out or sim > out[i][0]):
                            out[i] = (sim, int(x + p), int(min(n, x + p + int(size))))
    return [(i, *v) for i, v in sorted(out.items())]


def _starts(hit: np.ndarray, span: int, n: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of at most STEP window starts; each of the windows holds a hit."""
    lo, hi = np.maximum(hit - span + 1, 0), np.minimum(hit, n - span)
    cut = np.flatnonzero(lo[1:] > hi[:-1] + 1)
    for x, y in zip(lo[np.concatenate([[0], cut + 1])], hi[np.concatenate([cut, [len(hit) - 1]])] + 1, strict=True):
        for z in range(int(x), int(y), STEP):
            yield z, min(z + STEP, int(y))


_OUT = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _leaks(items: Items, array: pa.Array, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item row, similarity, start, end) of a batch; offsets are code points."""
    if not len(items.known):
        return
    _, first, *_ = _postings(items, least)
    rare = np.diff(first) > 0
    for s in slices(array):
        w = tokens(s)
        sh, at = shingle_hash(SpanHasher(w.data)(w.start, w.end), w.first, items.k)
        hit, place = _known(items, sh)
        for i in np.unique(np.searchsorted(at, hit[rare[place]], "right") - 1):
            lo, hi = np.searchsorted(hit, at[i : i + 2])
            a, b = w.first[i], w.first[i + 1]
            found = match(items, int(b - a), sh[at[i] : at[i + 1]], hit[lo:hi] - at[i], place[lo:hi], least)
            if found:
                cp = points(s.data[s.starts[i] : s.starts[i + 1]])
                for row, sim, x, y in found:
                    yield s.first + int(i), row, sim, int(cp[w.start[a + x] - s.starts[i]]), int(cp[w.end[a + y - 1] - s.starts[i]])


def _table(size: int) -> np.ndarray:
    """A bit table for that many shingles, 16 bits each and TABLE_BITS at most."""
    return np.zeros(min(TABLE_BITS, 1 << max(16, int(size * 16).bit_length())) // 8, np.uint8)


def _mark(table: np.ndarray, sh: np.ndarray) -> None:
    at = sh & U(len(table) * 8 - 1)
    np.bitwise_or.at(table, (at >> U(3)).astype(np.int64), (1 << (at & U(7)).astype(np.uint8)).astype(np.uint8))


def _marked(table: np.ndarray, sh: np.ndarray) -> np.ndarray:
    at = sh & U(len(table) * 8 - 1)
    return (table[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def _known(items: Items, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the shingles that items hold, and their places in ``known``: a bit table first, then a search
    among what passes."""
    table = items.index.get("bits")
    if table is None:
        table = items.index["bits"] = _table(len(items.known))
        _mark(table, items.known)
    some = np.flatnonzero(_marked(table, sh))
    at = np.searchsorted(items.known, sh[some])
    at[at == len(items.known)] = 0
    ok = items.known[at] == sh[some]
    return some[ok], at[ok]


def passes(benchmark: DataFrame, item_key: str = "item_id", text: str = "text", k: int = 5) -> Iterator[Items]:
    """The items in blocks of about PASS_WORDS words, in the order of their keys; a block is built when it is asked for."""
    rows = benchmark.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    ids, texts, held = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        held += int(tokens(next(slices(pa.array([r.t], pa.string())))).first[-1])
        if held >= PASS_WORDS:
            yield build(ids, texts, k)
            ids, texts, held = [], [], 0
    if ids:
        yield build(ids, texts, k)


def _holds_any(table: np.ndarray, k: int, text: str):
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for s in slices(b.column(text)):
                w = tokens(s)
                sh, at = shingle_hash(SpanHasher(w.data)(w.start, w.end), w.first, k)
                hit = np.flatnonzero(_marked(table, sh))
                keep[s.first + np.unique(np.searchsorted(at, hit, "right") - 1)] = True
            yield b.filter(pa.array(keep))

    return run


def _found(base: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, k: int, run) -> list[DataFrame]:
    """run(items), a function over batches of base(key, th, text), for each block of items: lazily for a benchmark of
    one block; of more, one by one over the texts that hold any of their shingles."""
    blocks = passes(benchmark, item_key, item_text, k)
    schema = "key long, th long, item_id long, similarity double, start long, end long"
    one, two = next(blocks, None), next(blocks, None)
    if one is None or two is None:
        return [base.mapInArrow(run(x), schema) for x in (one,) if x is not None]
    del one, two
    words = benchmark.agg(F.sum(F.length(item_text)).alias("n")).first().n // 2
    table = _table(int(words))
    for items in passes(benchmark, item_key, item_text, k):
        _mark(table, items.known)
    some = cut(base.mapInArrow(_holds_any(table, k, "text"), base.schema))
    del table
    return [cut(some.mapInArrow(run(items), schema)) for items in passes(benchmark, item_key, item_text, k)]


def _base(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(t).alias("th"), t.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_id, similarity, start, end): each text and item that share a passage, with the most
    similar window of the text, in code points. Words are lower-cased runs of letters and digits; keys must fit a long.

    Null and wordless texts and items match nothing, and items with a null key are left out. An item of under
    ``k`` words is one shingle and matches only texts of those words alone. A text shorter than an item is one
    window; of an item of over ITEM_WORDS words each window of that size gives a row. Of equally similar windows
    the first counts. Items whose key or rows repeat give a row each, and so do repeated texts. Other columns are
    ignored. Without items or texts the result is empty."""

    def finder(items: Items):
        def run(batches):
            for b in batches:
                found = list(_leaks(items, b.column("text"), least))
                if found:
                    rows = pa.array([x[0] for x in found])
                    yield batch_of(_OUT, [b.column("key").take(rows), b.column("th").take(rows), items.ids[[x[1] for x in found]], [x[2] for x in found], [x[3] for x in found], [x[4] for x in found]])

        return run

    base = _base(docs, key, text)
    made = _found(base, benchmark, item_key, "text", k, finder)
    if not made:
        return base.select(F.col("key").alias(key), *[F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("similarity", "double"), ("start", "long"), ("end", "long"))]).where("false")
    return reduce(DataFrame.unionByName, made).drop("th").withColumnRenamed("key", key)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs, all columns, without the rows that share a passage with an item. Null and wordless texts stay, repeated
    rows stay or go together, and an empty table or benchmark takes nothing away."""
    blocks = passes(benchmark, item_key, "text", k)
    one, two = next(blocks, None), next(blocks, None)
    if one is None:
        return docs
    if two is None:

        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for x in _leaks(one, b.column(text), least):
                    keep[x[0]] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    del one, two

    def finder(items: Items):
        def run(batches):
            for b in batches:
                rows = pa.array(sorted({x[0] for x in _leaks(items, b.column("text"), least)}), pa.int64())
                yield batch_of(_OUT, [b.column("key").take(rows), b.column("th").take(rows), *[pa.nulls(len(rows), f.type) for f in list(_OUT)[2:]]])

        return run

    gone = reduce(DataFrame.unionByName, _found(_base(docs, key, text), benchmark, item_key, "text", k, finder)).select(F.col("key").alias("__key"), F.col("th").alias("__th")).distinct()
    told = docs.withColumns({"__k": F.col(key).cast("long"), "__h": F.xxhash64(F.col(text).cast("string"))})
    return told.join(gone, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__th")), "left_anti").drop("__k", "__h")
