"""Source divergence, Merkle manifest and exact top-k against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithos.llm import divergence as D
from lithos.llm import manifest as M
from lithos.llm import topk as K

CLASH = ("term", "n", "docs", "vec", "p", "q", "rank", "value", "item", "part", "grp", "idx", "digest", "key", "uid", "path", "v", "d", "qb", "cb", "score")


def clash(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


# ---------------------------------------------------------------- op11


def plain_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = [tuple(x or "" for x in r) for r in rows]
    found, out = [(lang, source, Counter(low(w) for w in term.findall(t))) for t, lang, source in rows], set()
    for lang in {r[1] for r in rows}:
        docs, count, every = Counter(), defaultdict(Counter), Counter()
        for x, source, c in found:
            if x == lang:
                docs.update(c.keys())
                count[source].update(c)
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        for c in count.values():
            every.update({t: c[t] for t in kept})
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            pairs = [(o, sum(f(p(c, t), p(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(p(c, t), p(every, t))) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:top])):
                out |= {(lang, s, part, i, v, n) for n, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1)}
    return out


def test_divergence_by_plain_python(spark):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["École", "naïve", "漢字", "ABC"]
    for min_docs, top in ((3, 200), (1, 4)):
        rows = [(None, "en", "s0"), ("", None, None), ("1 2 3 --", "xx", "a"), ("one", "xx", "b"), ("Same same", None, "s1"), ("same", "", "s1"), ("same", "", None)]
        for i in range(150):
            source = "hot" if i % 3 == 0 else f"s{rnd.randrange(6)}"
            rows.append((" ".join(rnd.choice(words[: rnd.choice((5, 40, 84))]) + rnd.choice(("", ",", "3")) for _ in range(rnd.randint(0, 30))), rnd.choice(("en", "de")), source))
        rows += rows[-3:] * 2  # repeated rows
        df = clash(spark.createDataFrame(rows, "text string, lang string, source string"))
        got = [tuple(r) for r in D.divergence(df, min_docs, top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, min_docs, top)


def test_terms_of_slices_do_not_depend_on_their_size(spark, monkeypatch):
    texts = ["ab AB é1é", "x" * 40 + " b", None, "ab", "漢字 漢字", ""]
    want = None
    for size in (1, 30, 1 << 20):
        monkeypatch.setattr(D, "SLICE", size)
        batch = pa.record_batch([pa.array(["l"] * 6), pa.array(["s", "s", "t", "t", "t", "s"]), pa.array(texts)], ["lang", "source", "text"])
        seen = Counter()
        for b in D.count_terms(iter([batch])):
            for r in b.to_pylist():
                seen[r["lang"], r["source"], r["term"], "n"] += r["n"]
                seen[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        want = want or seen
        assert seen == want and seen["l", "s", "ab", "n"] == 2 and seen["l", "s", "é", "n"] == 2 and seen["l", "t", "漢字", "docs"] == 1


def test_large_counts_stay_exact(spark):
    big = 10**11  # the product with a billion passes 64 bits
    row = spark.range(1).select(D.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (3 * big + 7)


# ---------------------------------------------------------------- op12


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root and, for each leaf, its list of (left, right)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for i, j in enumerate(at):
            run = runs[j // arity]
            proofs[i].append(("".join(run[: j % arity]), "".join(run[j % arity + 1 :])))
        at, level = [j // arity for j in at], [digest(*r) for r in runs]
    return level[0], proofs


def plain_manifest(rows, arity):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for key, source, text in rows:
        groups[source].append((key is not None, key or 0, digest(enc(key), enc(source), enc(text)), key))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(groups[s])], arity) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops, strict=True):
        out += [(r[3], s, r[2], trees[s][0], root, tuple(p + top)) for r, p in zip(sorted(groups[s]), trees[s][1], strict=True)]
    return out


@pytest.mark.parametrize("arity, sizes", [(16, (1, 15, 16, 17, 256, 300)), (2, (1, 2, 3, 37, 64)), (3, (100,))])
def test_manifest_by_plain_python(spark, arity, sizes):
    rnd = random.Random(arity)
    rows = [(None, None, None), (None, "", ""), (4, "", "é"), (4, "", "é"), (4, "", "a")]
    for i, n in enumerate(sizes):
        rows += [(rnd.randrange(10**6) - 5000, f"src{i}é", rnd.choice(("x", "Yes", None, "漢"))) for _ in range(n)]
    rnd.shuffle(rows)
    df = clash(spark.createDataFrame(rows, "doc_id long, source string, text string")).repartition(7)
    out = M.manifest(df, ["doc_id", "source", "text"], arity=arity, carry={"shouted": F.sha2(M.framed("doc_id", "source", F.upper("text")), 256)})
    got = out.withColumn("again", M.fold(F.col("leaf"), F.col("proof"))).withColumn("forged", M.fold(F.col("shouted"), F.col("proof"))).collect()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in got], key=order) == sorted(plain_manifest(rows, arity), key=order)
    assert all(r.again == r.root for r in got) and {r.forged == r.root for r in got} == {True, False}
    assert all((r.forged == r.root) == (r.shouted == r.leaf) for r in got)


def test_partial_parents_wait_for_the_rest():
    """A task emits what its nodes complete and hands on the rest; halves met later give the same tree."""
    leaves = [digest(str(i)) for i in range(70)]
    root, _ = plain_tree(leaves, 4)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["grp", "n", "level", "idx", "digest"])

    nodes = [("g", 70, 0, i, d) for i, d in enumerate(leaves)]
    first = [r for part in (nodes[:21], nodes[21:50], nodes[50:]) for b in M.climb(4)(iter([batch(part)])) for r in b.to_pylist()]
    frontier = [(r["grp"], r["n"], r["level"], r["idx"], r["digest"]) for r in first if r["kind"] == "frontier"]
    assert not [r for r in first if r["kind"] == "root"] and 0 < len(frontier) < 25 and max(r[2] for r in frontier) > 0
    random.Random(1).shuffle(frontier)
    second = [r for b in M.climb(4)(iter([batch(frontier)])) for r in b.to_pylist()]
    assert [r["digest"] for r in second if r["kind"] == "root"] == [root] and not [r for r in second if r["kind"] == "frontier"]
    assert sum(r["kind"] == "run" for r in first + second) == 18 + 5 + 2 + 1


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.manifest(df, ["doc_id", "text"]).count() == 0 and D.divergence(df.withColumn("lang", F.lit("x"))).count() == 0


# ---------------------------------------------------------------- op13


def plain_top_k(rows, k, every, scale=256):
    ok = [(i, [float(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, queries = [], {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = max(queries.get(i, v), v)
    for q, v in queries.items():
        got = sorted((-int(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16384, 65536, 1024), (3, 7, 5)])
def test_top_k_by_plain_python(spark, monkeypatch, blocks):
    for name, n in zip(("QUERIES", "CANDIDATES", "LEAST"), blocks, strict=True):
        monkeypatch.setattr(K, name, n)
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    rows += [(i + 200, [0.5, 0.25, 0.0, -0.5]) for i in range(60)]  # one common vector: ties
    rows += [(400, None), (None, [1.0] * 4), (401, [1.0, None]), (402, [float("nan")] * 4), (450, [float("inf")]), (500, []), (403, [2.0]), (100, [9.0]), (100, [9.0]), (7, [3.0, 3.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    monkeypatch.setattr(K, "SAMPLE", 40)
    assert sorted(map(tuple, K.top_k(df, 5, every=10).collect())) == plain_top_k(rows, 5, 10)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, K.top_k(few).collect())) == plain_top_k([tuple(r) for r in few.collect()], 5, 50)
    assert K.top_k(few.where("vec_id = 0")).count() == 0 and K.top_k(few.where("false")).count() == 0


def test_bounds_hold_and_stop_the_search():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (12, 16))
    x = np.floor(centres[rng.integers(12, size=3000)] + rng.normal(0, 8, (3000, 16)))
    ids, pivots = np.arange(3000), K.pick_pivots(x[:500], 16)
    dist = lambda a: np.sqrt(((a[:, None] - pivots) ** 2).sum(-1))
    dx, nx, evaluated = dist(x), (x * x).sum(1), 0
    for q in range(0, 3000, 150):
        ub = K.bounds(x[q], dx[q], nx, dx)
        exact = x @ x[q]
        assert (ub >= exact).all()
        ub[q] = -np.inf
        best, scores, seen = K.search(x[q], ub, ids, x, 5, -1e300)
        exact[q] = -np.inf
        want = np.lexsort((ids, -exact))[:5]
        assert best.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
        evaluated += seen
    assert evaluated < 0.35 * 20 * 3000
    assert len(K.pick_pivots(np.zeros((9, 3)), 4)) == 1 and len(K.pick_pivots(np.zeros((0, 3)), 4)) == 0
