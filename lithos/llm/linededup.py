"""Removal of passages that texts share, by content-defined chunks of lines.

A text is cut into lines at line breaks and, so that unwrapped prose has lines too, after sentence
ends. A rolling hash over the last two line hashes sets chunk boundaries, so the same passage is mostly
cut alike wherever it stands; chunks are two lines or more, or one long line. Beside them stand anchors:
of all shortest runs of lines worth removing that lie in ``PASSAGE`` words from a line on, the one of
the least hash. What is chosen depends on those words alone, so any ``PASSAGE`` words of whole lines hold
an anchor that every copy has too. A chunk or anchor that occurs more than once in the
corpus is kept where it occurs first and removed elsewhere, once its bytes equal the first's. A
removed one then grows over neighbouring lines that equal the neighbours of the first occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import _P, _P_INV, _SPACE, U, Slice, SpanHasher, _power, batch_of, mix, points, runs, slices

#: A chunk ends where the rolling hash falls under this share of its range.
SHARE = 0.5
#: Words that make a chunk worth removing, and those of a line that is a chunk by itself.
CHUNK_WORDS, LINE_WORDS = 12, 24
#: Words of whole lines that are always found where they stand again.
PASSAGE = 50
#: Lines on either side that a removed chunk may grow over; more where these hold under ``PASSAGE`` words.
REACH = 8

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True  # ! . ?


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line that has a word, index of each row's first, words of each."""
    data, n = s.data, len(s.data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(s.starts), np.int64), z
    space = _SPACE[data]
    a, b, first = runs(~space, s.starts)
    if not len(a):
        return a, b, first, a
    # a word opens a line if it is its row's first, or a line break or a sentence end stands before it
    breaks = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
    opens = np.zeros(len(a), bool)
    opens[1:] = (breaks[a[1:]] > breaks[b[:-1]]) | _STOP[data[b[:-1] - 1]]
    opens[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(a)) - 1
    return a[at], b[last], np.searchsorted(at, first), last - at + 1


def chunks(s: Slice):
    """Lines, chunks and anchors of a slice: (start, end, words, line hash, index of each row's first line;
    first line, end line, hash and row of each chunk or anchor, in order of place, each span once)."""
    a, b, first, n = lines(s)
    h = SpanHasher(s.data)(a, b)
    m = len(a)
    if not m:
        return a, b, n, h, first, a, a, h, a
    before = np.empty(m, U)
    before[0] = 0
    before[1:] = h[:-1]
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = 0
    roll = mix(h + before * U(0x9E3779B97F4A7C15))
    ends = roll < U(int(SHARE * 2**64))  # a chunk ends with this line
    solo = n >= LINE_WORDS
    ends |= solo
    ends[:-1] |= solo[1:]
    tails = np.append(heads[1:], m) - 1
    ends[tails] = True
    e = np.flatnonzero(ends) + 1
    st = np.concatenate([[0], e[:-1]])
    ok = _worth(n, st, e)
    hasher = LineHasher(h)
    x, y = _anchors(n, first, hasher)
    spans = np.unique(np.concatenate([st[ok] * (m + 1) + e[ok], x * (m + 1) + y]))
    st, e = spans // (m + 1), spans % (m + 1)
    return a, b, n, h, first, st, e, hasher(st, e), np.searchsorted(first, st, "right") - 1


def _anchors(n: np.ndarray, first: np.ndarray, hasher: LineHasher) -> tuple[np.ndarray, np.ndarray]:
    """First and end line of the anchors. A run is the fewest lines from one on that are worth
    removing; each line chooses among the runs that end within ``PASSAGE`` words of its start, or its own if none does."""
    m = len(n)
    at = np.concatenate([[0], np.cumsum(n)])
    end = np.maximum(np.arange(1, m + 1) + (n < LINE_WORDS), np.searchsorted(at, at[:-1] + CHUNK_WORDS))  # never falls
    whole = end <= np.repeat(first[1:], np.diff(first))
    x = np.flatnonzero(whole)  # in a row, the lines that open a run come first
    if not len(x):
        return x, x
    end = np.minimum(end, m)
    g = np.zeros(m, U)
    g[x] = hasher(x, end[x])
    runs_of = np.concatenate([[0], np.cumsum(whole)])
    stop = np.repeat(first[:-1] + np.diff(runs_of[first]), np.diff(first))[x] - 1
    stop = np.maximum(x, np.minimum(stop, np.searchsorted(at[end], at[x] + PASSAGE, "right") - 1))
    best, live, k = x.copy(), np.arange(len(x)), 1
    while len(live := live[x[live] + k <= stop[live]]):
        j = x[live] + k
        best[live] = np.where(g[j] < g[best[live]], j, best[live])
        k += 1
    best = np.unique(best)
    return best, end[best]


_HASHES = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), ("again", pa.bool_())])
_BODIES = pa.schema(
    [("h", pa.int64()), ("rid", pa.int64()), ("first", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32()), ("body", pa.binary()), ("prev", pa.list_(pa.int64())), ("next", pa.list_(pa.int64()))]
)


class LineHasher:
    """Order-sensitive hashes of runs of lines, whatever their place."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h) * _power(_P, len(h))[: len(h)])])
        self.back = _power(_P_INV, len(h) + 1)

    def __call__(self, st: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[st]) * self.back[st] + (e - st).astype(U) * U(0xA0761D6478BD642F))


def _worth(n: np.ndarray, st: np.ndarray, e: np.ndarray) -> np.ndarray:
    words = np.add.reduceat(n, st)
    return ((e - st >= 2) & (words >= CHUNK_WORDS)) | (words >= LINE_WORDS)


def _repeats(g: np.ndarray, row: np.ndarray, st: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a hash stood earlier in the same row, and whether its first place there overlaps this one."""
    order = np.lexsort((np.arange(len(g)), g, row))
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[order[1:]] != g[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))]
    same, over = np.empty(len(g), bool), np.empty(len(g), bool)
    same[order] = ~fresh
    over[order] = ~fresh & (st[order] < e[lead])
    return same, over


def _hash_rows(batches):
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        for s in slices(batch.column("text")):
            *_, st, e, g, row = chunks(s)
            if not len(st):
                continue
            no = np.arange(len(st)) - np.searchsorted(row, row)
            again, over = _repeats(g, row, st, e)
            at = s.first + row[~over]
            yield batch_of(_HASHES, [g[~over].view(np.int64), rid[at], key[at], no[~over].astype(np.int32), again[~over]])


def _bodies_of(text: str, todo: str):
    """Rows with a list of (chunk number, hash, first) -> the bytes of those chunks, and for a first
    occurrence the hashes of the lines around it, nearest first."""

    def run(batches):
        for batch in batches:
            rid = batch.column("__rid").to_numpy(zero_copy_only=False)
            lists = batch.column(todo)
            offs = np.asarray(lists.offsets)
            item = lists.values
            no_, g_, first_ = (np.asarray(item.field(x)) for x in ("no", "h", "first"))
            for s in slices(batch.column(text)):
                a, b, n, h, lines_at, st, e, _, row = chunks(s)
                words = np.concatenate([[0], np.cumsum(n)])
                back = np.minimum(st - REACH, np.searchsorted(words, words[st] - PASSAGE))
                ahead = np.maximum(e + REACH, np.searchsorted(words, words[e] + PASSAGE))
                out = []
                raw = s.data.tobytes()
                edge = np.searchsorted(row, np.arange(s.rows + 1))
                for i in range(s.rows):
                    c0, c1 = edge[i], edge[i + 1]
                    if c0 == c1:
                        continue
                    l0, l1 = lines_at[i], lines_at[i + 1]
                    for q in range(offs[s.first + i], offs[s.first + i + 1]):
                        c = c0 + no_[q]
                        x, y = st[c], e[c]
                        prev = h[max(l0, back[c]) : x][::-1] if first_[q] else h[:0]
                        nxt = h[y : min(l1, ahead[c])] if first_[q] else h[:0]
                        out.append((g_[q], rid[s.first + i], first_[q], x - l0, y - l0, raw[a[x] : b[y - 1]], prev.view(np.int64), nxt.view(np.int64)))
                if out:
                    yield batch_of(_BODIES, [list(c) for c in zip(*out, strict=True)])

    return run


def _grown(h: np.ndarray, at: np.ndarray, stop: np.ndarray, near: pa.ListArray, step: int) -> np.ndarray:
    """Edges of cuts, moved line by line up to ``stop`` while the next line has the hash that ``near`` lists for it."""
    offs, want = np.asarray(near.offsets), np.asarray(near.values)
    n, live, k = np.diff(offs), np.arange(len(at)), 0
    while len(live := live[(n[live] > k) & (at[live] != stop[live])]):
        live = live[h[at[live] - (step < 0)] == want[offs[live] + k]]
        at[live] += step
        k += 1
    return at


def _without(s: Slice, row: np.ndarray, cuts: pa.StructArray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a slice's rows without the cut lines, and the cuts as code-point spans: their number in each row, starts, ends. cuts: (lo, hi, prev, next),
    each of the given row."""
    a, b, first, _ = lines(s)
    h = SpanHasher(s.data)(a, b).view(np.int64)
    lo, hi, prev, nxt = cuts.flatten()
    change = np.zeros(len(a) + 1, np.int64)
    np.add.at(change, _grown(h, first[row] + np.asarray(lo), first[row], prev, -1), 1)
    np.add.at(change, _grown(h, first[row] + np.asarray(hi), first[row + 1], nxt, 1), -1)
    d, e, of = runs(np.cumsum(change[:-1]) > 0, first)
    count = np.diff(of)
    mine = np.repeat(np.arange(s.rows), count)
    x = a[d]
    y = np.where(e < first[mine + 1], np.append(a, 0)[e], s.starts[mine + 1])
    raw, texts = s.data.tobytes(), []
    for i in range(s.rows):
        t1 = int(s.starts[i + 1])
        ends = [int(s.starts[i]), *y[of[i] : of[i + 1]].tolist()]
        text = b"".join([raw[p:q] for p, q in zip(ends, [*x[of[i] : of[i + 1]].tolist(), t1], strict=True)])
        texts.append(text.rstrip() if count[i] and ends[-1] == t1 else text)
    cp = points(s.data)
    base = cp[s.starts[mine]]
    return texts, count, cp[x] - base, cp[y] - base


def _cutter(text: str, todo: str, keep: list[str], removed: str):
    def run(batches):
        for batch in batches:
            col, lists = batch.column(text), batch.column(todo)
            at = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) > 0)  # other rows stay as they are
            cuts = lists.take(pa.array(at))
            offs = np.asarray(cuts.offsets)
            texts: list = []
            count, spans = np.zeros(len(col), np.int64), []
            for s in slices(col.take(pa.array(at))):
                q = offs[s.first : s.first + s.rows + 1]
                t, n, *se = _without(s, np.repeat(np.arange(s.rows), np.diff(q)), cuts.values.slice(q[0], q[-1] - q[0]))
                texts += t
                count[at[s.first : s.first + s.rows]] = n
                spans.append(se)
            place = np.arange(len(col))
            place[at] = len(col) + np.arange(len(at))
            se = [pa.array(np.concatenate([x[i] for x in spans] or [np.empty(0, np.int64)])) for i in (0, 1)]
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            made = {
                text: pa.concat_arrays([col, pa.array(texts, pa.binary()).cast(col.type)]).take(pa.array(place)),
                removed: pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(se, ["start", "end"])),
            }
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in [*keep, removed]], [*keep, removed])

    return run


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """docs, all columns and rows, with ``text`` freed of repeated passages, and ``removed``, the
    code-point spans of the original text that are gone (a column of that name is replaced).

    A passage stays in the row with the smallest key (a null key orders last), where it stands first.
    White space after a removed line goes with it. Rows with the same key and text are one text: the
    passage stays in each of them; so do rows of the smallest key with different texts. Null, empty
    and blank texts are returned as they are; so are texts of one short line. Chunks are
    compared byte by byte with the first occurrence; lines that a removal grows over by 64-bit hash.
    """
    spare = docs.drop(removed)
    keep = spare.columns
    ided = spare.withColumn("__rid", F.xxhash64(F.col(key), F.col(text)))
    base = ided.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.col("__rid").alias("rid"), F.col(text).alias("text"))
    rows = base.mapInArrow(_hash_rows, "h long, rid long, key long, no int, again boolean")
    # small, and cut so that the join has an exchange on either side: Spark splits a hot hash only then
    rep = cut(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1").select("h", "least"))
    cand = rows.join(rep, "h").select("rid", F.struct("no", "h", (F.expr("key = least and not again")).alias("first")).alias("c"))
    # rows with the same key and text give the same chunks; each list is held once
    cand = cand.groupBy("rid").agg(F.collect_set("c").alias("__todo"))
    # the texts are dealt by row once: this join and the last read the same exchange
    bodies = ided.join(cand.withColumnRenamed("rid", "__rid"), "__rid").mapInArrow(
        _bodies_of(text, "__todo"), "h long, rid long, first boolean, lo int, hi int, body binary, prev array<long>, next array<long>"
    )
    first = bodies.where("first").select("h", F.col("body").alias("body0"), "prev", "next").dropDuplicates(["h"])
    gone = bodies.where("not first").select("h", "rid", "lo", "hi", "body").join(first, "h").where("body = body0")
    gone = gone.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi", "prev", "next")).alias("__todo")).withColumnRenamed("rid", "__rid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text else 'string'}" for f in spare.schema.fields)
    return ided.join(gone, "__rid", "left").mapInArrow(_cutter(text, "__todo", keep, removed), f"{schema}, `{removed}` array<struct<start: bigint, end: bigint>>")
