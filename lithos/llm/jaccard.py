"""Exact Jaccard self-join on word shingles: signature trees inside pigeonhole groups.

1. Every text becomes the set of its distinct k-word shingles (64-bit hashes). Equal sets collapse to
   one class, so copies cost nothing further. A class is named by a 64-bit digest; a second one tells whether
   two sets share a name, and then all names are drawn anew.
2. Sets that can link differ in a bounded number of shingles. The hash range is cut into more parts
   than that number, so linked sets agree on a whole non-empty part; every part's digest is a row.
   Only parts shared by different classes go on, and of parts with the same members one. No similarity
   decision is taken here.
3. Within each part, trees of small bitmaps drop the pairs that sizes and bitmaps rule out; classes that
   are left together, directly or by steps, form groups. A group of bounded weight is one
   signature tree: nodes hold OR-combined token bitmaps, size ranges and the most tokens that
   colliding bits hide; a dual traversal drops node pairs whose greatest possible overlap is too
   small, and pairs of nodes that are already one component; what is left is compared exactly.
4. A group over the bound is first compared along the pairs that hold it together (salted), which links any
   crowd of near copies in linear work; parts whose members are then still in different components are cut
   into blocks of bounded weight, and trees of block pairs are traversed likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, cut, sweep
from .tokens import U, batch_of, mix, shingle_hash, slices, word_hash, words

#: Shingles and members of one tree; a group beyond either is dealt in blocks.
TREE_WEIGHT, TREE_MEMBERS = 1 << 22, 4096
#: Rows that one copy of a pivot's set meets in the pivot join.
PIVOT_ROWS = 512
LEAF = 8


# ---------------------------------------------------------------- shingle sets


def _sets(array, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for s in slices(array):
        w = words(s, lower)
        h, at = shingle_hash(word_hash(w), w.first, k)
        for i in range(s.rows):
            yield s.first + i, np.unique(h[at[i] : at[i + 1]])


def _digest(x: np.ndarray, draw: int = 0) -> int:
    """The 64-bit name of a set under a draw."""
    salt = U((0x5851F42D4C957F2D + draw * 0xD1342543DE82EF95) & ((1 << 64) - 1))
    return int(mix(np.array([int(mix(x ^ salt).sum(dtype=U)) ^ len(x)], U)).view(np.int64)[0])


_CLASSES = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("twin", pa.int64()), ("bits", pa.binary())])
#: Draws of names before two sets that still share one are an error; one is enough but for one table in many.
DRAWS = 8

#: Least and greatest bits of the bitmap that stands for a set before the set itself is at hand; it has
#: two bits or more for each token. A set too large for the greatest has none.
SKETCH_LEAST, SKETCH_MOST = 256, 1 << 17


def _sketch(x: np.ndarray) -> bytes:
    width = SKETCH_LEAST
    while width < 2 * len(x):
        width *= 2
    if width > SKETCH_MOST:
        return b""
    row = np.zeros(width, bool)
    row[((mix(x) >> U(24)) & U(width - 1)).astype(np.int64)] = True
    return np.packbits(row).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of a smaller width, a power of two: halves are laid over each other."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def _classes_of(k: int, lower: bool, draw: int):
    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            d = np.zeros(b.num_rows, np.int64)
            twin = np.zeros(b.num_rows, np.int64)
            bits = [b""] * b.num_rows
            for i, x in _sets(b.column("text"), k, lower):
                n[i] = len(x)
                if len(x):
                    d[i], twin[i], bits[i] = _digest(x, draw), _digest(x, -1 - draw), _sketch(x)
            yield batch_of(_CLASSES, [b.column("key"), b.column("th"), n, pa.array(d, mask=n == 0), twin, pa.array(bits, pa.binary())])

    return run


# ---------------------------------------------------------------- part signatures


@lru_cache(maxsize=4096)
def _band(i: int, t: float) -> tuple[int, int, int]:
    """(least size, greatest size, parts) of a band; bands grow by half."""
    lo, hi = 1, 1
    for _ in range(i):
        lo = hi + 1
        hi = max(lo, lo * 3 // 2 - 1)
    k = int((1 - t) / (1 + t) * 2 * hi + 1e-9)
    if k == 0:
        return lo, hi, 1
    m = k + 1
    while m < 4 * hi:
        empty = exp(-hi / m)
        if m * (1 - empty) - 3 * sqrt(m * empty) - 1 >= k + 1:
            break
        m += max(1, m // 64)
    return lo, hi, m


@lru_cache(maxsize=64)
def _bands(t: float) -> np.ndarray:
    out = [_band(i, t)[1] for i in range(100)]
    return np.array(out)


def part_signatures(x: np.ndarray, t: float) -> np.ndarray:
    """One digest for each non-empty part, under the set's own band and, where a larger partner may
    lie in the next band, under that one too. Two sets with Jaccard t or more share a digest: at
    most k parts hold a difference; if one of the sets fills over k parts, one of those is free of
    differences, and sets that fill no more also give digests of their empty parts."""
    s = len(x)
    if not s:
        return np.empty(0, U)
    bands = _bands(t)
    b = int(np.searchsorted(bands, s))
    out = []
    while True:
        lo, hi, m = _band(b, t)
        k = min(int((1 - t) / t * s + 1e-9), int((1 - t) / (1 + t) * (s + hi) + 1e-9))
        salt = U((b * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
        if m == 1:
            out.append(mix(np.array([mix(x ^ salt).sum(dtype=U)], U) + salt))
        else:
            part = ((x >> U(32)) * U(m)) >> U(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.add.reduceat(mix(x ^ salt), at)
            p = part[at]
            out.append(mix(sums + (p + U(1)) * U(0xA0761D6478BD642F) + salt))
            if len(p) < k + 1:
                gone = np.setdiff1d(np.arange(m, dtype=U), p)
                out.append(mix((gone + U(1)) * U(0xE7037ED1A0B428DB) + salt))
        if int(s / t + 1e-9) <= hi:
            break
        b += 1
        if _band(b, t)[0] > int(s / t + 1e-9):
            break
    return np.concatenate(out)


_SIGS = pa.schema([("sig", pa.int64()), ("cls", pa.int64())])


def _signatures_of(k: int, t: float, lower: bool, draw: int):
    def run(batches):
        for b in batches:
            sigs, ids, held = [], [], 0
            for _, x in _sets(b.column("text"), k, lower):
                if not len(x):
                    continue
                g = part_signatures(x, t)
                sigs.append(g)
                ids.append(np.full(len(g), _digest(x, draw), np.int64))
                held += len(g)
                if held > 200_000:
                    yield batch_of(_SIGS, [np.concatenate(sigs).view(np.int64), np.concatenate(ids)])
                    sigs, ids, held = [], [], 0
            if held:
                yield batch_of(_SIGS, [np.concatenate(sigs).view(np.int64), np.concatenate(ids)])

    return run


# ---------------------------------------------------------------- signature tree


def need(a, b, t: float):
    """The least overlap at which sets of sizes a and b have Jaccard t."""
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9)


def linked(x: np.ndarray, y: np.ndarray, t: float) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    both = int((y[at] == x).sum())
    return both >= int(need(len(x), len(y), t))


class Tree:
    """Nodes of one level are runs of LEAF nodes of the level below; level 0 is the sets."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, first: np.ndarray, hidden: np.ndarray | None = None):
        """bits (n, words) of the sets' tokens, sizes, a number that is alike for similar sets, and the tokens
        that share bits, where bits alone don't tell."""
        self.order = np.lexsort((first, size))
        bits, size = bits[self.order], size[self.order]
        hidden = size - np.bitwise_count(bits).sum(1).astype(np.int64) if hidden is None else hidden[self.order]
        self.levels = [(bits, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, hid = self.levels[-1]
            at = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)))


def tree_of(sets: list[np.ndarray]) -> Tree:
    size = np.array([len(x) for x in sets])
    least = np.array([int(x[0]) if len(x) else 0 for x in sets], U)
    width = 64
    while width < 2 * size.max() and width < 8192:
        width *= 2
    bits = np.zeros((len(sets), width // 8), np.uint8)
    for i, x in enumerate(sets):
        row = np.zeros(width, bool)
        row[((mix(x) >> U(20)) % U(width)).astype(np.int64)] = True
        bits[i] = np.packbits(row)
    return Tree(bits.view(U), size, least)


def _possible(level, i: np.ndarray, j: np.ndarray, other, t: float) -> np.ndarray:
    """Of node pairs i x j: whether sizes and the greatest possible overlap allow a link."""
    bits, lo, hi, hid = level
    obits, olo, ohi, ohid = other
    fits = (lo[i][:, None] * t <= ohi[j][None, :] + 1e-9) & (olo[j][None, :] * t <= hi[i][:, None] + 1e-9)
    both = np.bitwise_count(bits[i][:, None, :] & obits[j][None, :, :]).sum(2).astype(np.int64)
    most = np.minimum(both + np.minimum(hid[i][:, None], ohid[j][None, :]), np.minimum(hi[i][:, None], ohi[j][None, :]))
    return fits & (most >= need(lo[i][:, None], olo[j][None, :], t))


def traverse(tree: Tree, t: float, link, comp: np.ndarray | None = None, all_links: bool = False) -> list[tuple[int, int]]:
    """Dual traversal: pairs that ``link`` confirms, enough to connect every component (all_links: all of
    them). comp: components that are known already; pairs within one are passed over."""
    n = len(tree.order)
    label = np.arange(n) if comp is None else np.unique(comp, return_inverse=True)[1][tree.order]
    found: list[tuple[int, int]] = []
    stack = [(len(tree.levels) - 1, 0, 0)]
    if n == 1:
        return found
    while stack:
        lv, a, b = stack.pop()
        if lv == 0:
            i, j = int(tree.order[a]), int(tree.order[b])
            if (all_links or label[a] != label[b]) and link(i, j):
                found.append((i, j))
                if not all_links:
                    label[label == label[b]] = label[a]
            continue
        span = LEAF**lv
        la, lb = label[a * span : (a + 1) * span], label[b * span : (b + 1) * span]
        if not all_links and la.min() == la.max() == lb.min() == lb.max():
            continue
        below = tree.levels[lv - 1]
        i = np.arange(a * LEAF, min((a + 1) * LEAF, len(below[0])))
        j = i if a == b else np.arange(b * LEAF, min((b + 1) * LEAF, len(below[0])))
        ok = _possible(below, i, j, below, t)
        if a == b:
            ok = np.triu(ok, 1 if lv == 1 else 0)
        x, y = np.nonzero(ok)
        near = np.argsort(-np.abs(i[x] - j[y]), kind="stable")  # own pairs are popped first
        stack.extend((lv - 1, int(i[x[q]]), int(j[y[q]])) for q in near)
    return found


def tree_links(sets: list[np.ndarray], t: float, comp: np.ndarray | None = None, all_links: bool = False) -> list[tuple[int, int]]:
    if len(sets) < 2:
        return []
    return traverse(tree_of(sets), t, lambda i, j: linked(sets[i], sets[j], t), comp, all_links)


def _part_edges(t: float):
    """Sorted (sig, cls, n, bits) rows -> edges that connect the members of each part whose sizes and
    bitmaps allow a link, by the same traversal without a final comparison."""

    def close(cls, n, bits):
        width = min((len(b) for b in bits if b), default=SKETCH_LEAST // 8)
        x = np.stack([_folded(b, width) if b else np.full(width, 255, np.uint8) for b in bits]).view(U)
        size = np.array(n, np.int64)
        # a set without a bitmap may hold any token
        hidden = np.where([bool(b) for b in bits], size - np.bitwise_count(x).sum(1).astype(np.int64), size)
        got = traverse(Tree(x, size, x[:, 0], hidden), t, lambda i, j: True)
        return [(cls[i], cls[j]) for i, j in got]

    def run(batches):
        now, rows, links = None, [], []
        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("sig", "cls", "n", "bits")), strict=True):
                if g != now:
                    if len(rows) > 1:
                        links += close(*zip(*rows, strict=True))
                    now, rows = g, []
                rows.append(row)
            if links:
                yield batch_of(_LINKS, [[x for x, _ in links], [y for _, y in links]])
                links = []
        if len(rows) > 1:
            links += close(*zip(*rows, strict=True))
        if links:
            yield batch_of(_LINKS, [[x for x, _ in links], [y for _, y in links]])

    return run


def _hopeful(t: float):
    """Pairs (a, na, xa, b, nb, xb) whose sizes and bitmaps allow a link."""

    def run(batches):
        for p in batches:
            na, nb = (p.column(c).to_numpy() for c in ("na", "nb"))
            ok = (na >= nb * t - 1e-9) & (nb >= na * t - 1e-9)
            least = need(na, nb, t)
            xa, xb = p.column("xa"), p.column("xb")
            for i in np.flatnonzero(ok):
                x, y = xa[i].as_py(), xb[i].as_py()
                if x and y:
                    width = min(len(x), len(y))
                    x, y = _folded(x, width).view(U), _folded(y, width).view(U)
                    hidden = min(na[i] - int(np.bitwise_count(x).sum()), nb[i] - int(np.bitwise_count(y).sum()))
                    ok[i] = int(np.bitwise_count(x & y).sum()) + hidden >= least[i]
            keep = pa.array(ok)
            yield batch_of(_LINKS, [p.column("a").filter(keep), p.column("b").filter(keep)])

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tree_of(t: float):
    """Sorted (grp, cls, comp, items) rows -> links; one group is held at a time."""

    def close(cls, sets, comp):
        got = tree_links(sets, t, np.array(comp)) if len(sets) > 1 else []
        return [(cls[i], cls[j]) for i, j in got]

    def run(batches):
        now, cls, sets, comp, links = None, [], [], [], []
        for b in batches:
            items = b.column("items")
            offs = np.asarray(items.offsets)
            values = np.asarray(items.values).view(U)
            for i, (g, c, m) in enumerate(zip(b.column("grp").to_pylist(), b.column("cls").to_pylist(), b.column("comp").to_pylist(), strict=True)):
                if g != now:
                    links += close(cls, sets, comp)
                    now, cls, sets, comp = g, [], [], []
                if not cls or cls[-1] != c:
                    cls.append(c)
                    sets.append(values[offs[i] : offs[i + 1]].copy())
                    comp.append(m)
            if links:
                yield batch_of(_LINKS, [[x for x, _ in links], [y for _, y in links]])
                links = []
        links += close(cls, sets, comp)
        if links:
            yield batch_of(_LINKS, [[x for x, _ in links], [y for _, y in links]])

    return run


def _pivot_of(t: float):
    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                ok[i] = linked(np.asarray(x[i].values).view(U), np.asarray(y[i].values).view(U), t)
            keep = pa.array(ok)
            yield batch_of(_LINKS, [b.column("a").filter(keep), b.column("b").filter(keep)])

    return run


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, k: int = 5, t: float = 0.8, key: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    Words are runs of bytes other than space and \\t-\\r; A-Z is lower-cased when ``lower``. A row's set is
    its distinct k-word shingles; fewer words give one shingle. Two rows link when their Jaccard
    similarity is t or more; component_id is the smallest key within reach. Null, empty and blank texts
    have an empty set and link with nothing. A null key is kept and orders last. Rows that share a key
    are each returned. Other columns are ignored. An empty table gives an empty result.
    """
    return _components_of(docs, k, t, key, text, lower).select(F.col("key").alias(key), "n_shingles", "component_id")


def _components_of(docs: DataFrame, k: int, t: float, key: str, text: str, lower: bool) -> DataFrame:
    """(key, th, n_shingles, component_id); th is a hash of the text."""
    base = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    for draw in range(DRAWS):
        drawn = cut(base.mapInArrow(_classes_of(k, lower, draw), "key long, th long, n_shingles long, cls long, twin long, bits binary"))
        named = drawn.where("cls is not null").groupBy("cls").agg(F.min("twin").alias("x"), F.max("twin").alias("y"))
        if not named.where("x <> y").limit(1).count():
            break
    else:
        raise RuntimeError("sets with equal digests")
    rows = drawn.select("key", "th", "n_shingles", "cls")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n"))

    sigs = base.select("text").mapInArrow(_signatures_of(k, t, lower, draw), "sig long, cls long")
    shared = sigs.groupBy("sig").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).where("pivot <> other").select("sig", "pivot")
    members = cut(sigs.join(shared, "sig").groupBy("sig", "pivot", "cls").agg(F.lit(1).alias("x")).drop("x"))
    # parts with the same members are one: a long text has very many parts, near copies of it share most of them
    counts = members.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("twin"), "cls")).alias("s2"))
    counts = counts.groupBy("c", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig", "c")
    sized = cut(members.join(counts, "sig"))
    # sizes and bitmaps of the classes rule out most chance pairs before any set is moved: a part of two
    # classes is one pair, a larger one a tree of bitmaps; beyond the bound of a tree the pivot stands for all
    edges = sized.where("pivot <> cls").groupBy("pivot", "cls").agg(F.max("c").alias("most"), F.min("c").alias("c")).select(F.col("pivot").alias("a"), F.col("cls").alias("b"), "c", "most")
    known = drawn.where("cls is not null").dropDuplicates(["cls"]).select("cls", F.col("n_shingles").alias("n"), "bits")
    left, right = (known.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")) for x in ("a", "b"))
    duo = edges.where("c = 2").join(left, "a").join(right, "b").select("a", "na", "xa", "b", "nb", "xb").mapInArrow(_hopeful(t), "a long, b long")
    tree = sized.where(f"c > 2 and c <= {TREE_MEMBERS}").join(known, "cls").select("sig", "cls", "n", "bits")
    tree = tree.repartition(_width(docs), "sig").sortWithinPartitions("sig", "cls").mapInArrow(_part_edges(t), "a long, b long")
    crowd = edges.where(f"most > {TREE_MEMBERS}").select("a", "b")
    star = cut(duo.unionByName(tree).unionByName(crowd).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    group = components(star).withColumnRenamed("id", "cls").withColumnRenamed("comp", "grp")
    group = cut(group.join(classes.select("cls", "key", "n"), "cls"))
    weight = group.groupBy("grp").agg(F.sum("n").alias("weight"), F.count("*").alias("count"))
    large = cut(weight.where((F.col("weight") > TREE_WEIGHT) | (F.col("count") > TREE_MEMBERS)).select("grp").coalesce(8))
    has_large = large.limit(1).count() > 0

    # the sets of one row of each class that is in a group
    wanted = group.where("key is not null").select("key", "cls")
    sets = base.join(wanted, "key").mapInArrow(_shingles_with("cls", k, lower, draw), "cls long, items array<long>")
    nullkey = group.where("key is null").select("cls")
    if nullkey.limit(1).count():
        orphans = base.where("key is null").mapInArrow(_with_class(k, lower, draw), "key long, text string, cls long").join(nullkey, "cls").dropDuplicates(["cls"])
        sets = sets.unionByName(orphans.select("key", "text", "cls").mapInArrow(_shingles_with("cls", k, lower, draw), "cls long, items array<long>"))
    sets = cut(sets)
    sweep(docs.sparkSession)

    small = group.join(large, "grp", "left_anti").select("grp", "cls", F.col("cls").alias("comp"))
    todo = small
    links = None
    if has_large:
        big = group.join(large, "grp").select("cls", "n")
        pairs = star.join(big.select(F.col("cls").alias("b")), "b").select("a", "b")
        pivots = cut(_pivot_join(pairs, sets, t))
        known = components(pivots)
        comp = big.join(known, big.cls == known.id, "left").select("cls", "n", F.coalesce("comp", "cls").alias("comp"))
        parts = sized.drop("c").join(comp, "cls")
        split = (
            parts.groupBy("sig")
            .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("same"))
            .where("lo <> hi")
        )
        split = split.groupBy("c", "w", "same").agg(F.min("sig").alias("sig"))  # parts with the same members are one
        split = split.select("sig", F.ceil(F.greatest(F.col("w") * 2 / TREE_WEIGHT, F.col("c") * 2 / TREE_MEMBERS)).cast("int").alias("nb"))
        blocks = parts.join(split, "sig").select("sig", "cls", "comp", "nb", F.pmod(F.xxhash64("cls"), "nb").cast("int").alias("blk"))
        blocks = blocks.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
        blocks = blocks.select(F.xxhash64("sig", F.least("blk", "o"), F.greatest("blk", "o")).alias("grp"), "cls", "comp")
        todo = todo.unionByName(blocks)
        links = pivots
    made = todo.join(sets, "cls").select("grp", "cls", "comp", "items")
    made = made.repartition(_width(docs), "grp").sortWithinPartitions("grp", "cls").mapInArrow(_tree_of(t), "a long, b long")
    links = cut(made if links is None else made.unionByName(links))
    comp = components(links)
    first = comp.join(classes, comp.id == classes.cls).groupBy("comp").agg(F.min("key").alias("least"))
    named = comp.join(first, "comp").select(F.col("id").alias("cls"), "least")
    named = classes.join(named, "cls", "left").select("cls", F.coalesce("least", "key").alias("component_id"))
    # blank texts are of no class; they stay out of the join, where they would be one task
    blank = rows.where("cls is null").select("key", "th", "n_shingles", F.col("key").alias("component_id"))
    return rows.where("cls is not null").join(named, "cls").select("key", "th", "n_shingles", "component_id").unionByName(blank)


def _width(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_class(k: int, lower: bool, draw: int):
    def run(batches):
        for b in batches:
            d = np.zeros(b.num_rows, np.int64)
            for i, x in _sets(b.column("text"), k, lower):
                d[i] = _digest(x, draw) if len(x) else 0
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(d)], ["key", "text", "cls"])

    return run


def _shingles_with(name: str, k: int, lower: bool, draw: int):
    """Rows (…, text, cls) -> (cls, items), for rows whose own class is that one; a class once a task."""
    schema = pa.schema([(name, pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            cls = b.column(name).to_numpy(zero_copy_only=False)
            ids, rows, held = [], [], 0
            for i, x in _sets(b.column("text"), k, lower):
                if len(x) and cls[i] not in seen and _digest(x, draw) == cls[i]:
                    seen.add(int(cls[i]))
                    ids.append(cls[i])
                    rows.append(x.view(np.int64))
                    held += len(x)
                if held > 500_000:
                    yield _lists(schema, ids, rows)
                    ids, rows, held = [], [], 0
            if rows:
                yield _lists(schema, ids, rows)

    return run


def _lists(schema, ids, rows):
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows)))], schema=schema)


def _pivot_join(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Exact check of (pivot a, member b). A pivot's set is copied once for every PIVOT_ROWS members."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("copies"))
    left = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("salt"))
    left = left.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    right = copies.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").select("a", "x", F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"))
    return left.join(right, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(_pivot_of(t), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, t: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest key of each component; rows that link with nothing all stay, and so
    do rows with a null key. Rows of one key with different texts are each judged by their own text;
    repeated rows stay or go together. Null, empty and blank texts link with nothing; an empty table
    gives an empty result. Other columns are passed on; keys must fit a long."""
    made = _components_of(docs, k, t, key, text, True)
    gone = made.where("key > component_id").select(F.col("key").alias("__key"), F.col("th").alias("__th")).distinct()
    told = docs.withColumns({"__k": F.col(key).cast("long"), "__h": F.xxhash64(F.col(text).cast("string"))})
    return told.join(gone, (F.col("__k") == F.col("__key")) & (F.col("__h") == F.col("__th")), "left_anti").drop("__k", "__h")
