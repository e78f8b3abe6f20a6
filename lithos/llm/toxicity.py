"""Toxic spans by a linear-chain conditional random field over two labels.

Training is one task over a bounded sample; scoring is one pass over all texts. Forward and
backward recursions treat a slice of texts as one chain that restarts at each text, cut into chunks
whose transfer matrices are multiplied side by side, so the work is vectorised whatever the lengths.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import U, SpanHasher, Words, batch_of, mix, points, slices, tokens

#: Rows of each label that training may use.
TRAIN_ROWS = 1000
FEATURES = 1 << 18
CHUNK = 64


@dataclass
class Crf:
    weight: np.ndarray  # of a hashed feature, for label 1 against 0
    move: np.ndarray  # 2 x 2 log-potentials of neighbouring labels
    start: np.ndarray
    blend: tuple[float, ...] = (1.0, 0.0, 0.0, -3.0)  # document score: weights of ``_gather``'s columns, and the constant


#: Bytes of the word beginnings that are features of their own.
STEMS = (4, 5, 6, 7, 8)


def spellings(w: Words) -> np.ndarray:
    """(7, n) hashes: the word, and its beginnings of STEMS bytes (0 where the word is shorter), and
    its last four bytes."""
    h = SpanHasher(w.data)
    length = w.end - w.start
    out = np.zeros((len(STEMS) + 2, len(length)), U)
    out[0] = h(w.start, w.end)
    for j, n in enumerate(STEMS, 1):
        out[j] = np.where(length >= n, mix(h(w.start, w.start + np.minimum(n, length)) + U(n)), U(0))
    out[-1] = mix(h(w.end - np.minimum(length, 4), w.end) + U(99))
    return out


def features(w: Words, spelt: np.ndarray | None = None) -> np.ndarray:
    """(8, n) feature numbers: ``spellings`` and the length."""
    x = spellings(w) if spelt is None else spelt
    return np.concatenate([((x >> U(40)) % U(FEATURES)).astype(np.int32), np.minimum(w.end - w.start, 30).astype(np.int32)[None]])


def _emission(model: Crf, f: np.ndarray) -> np.ndarray:
    e = model.weight[f[0]]
    for row in f[1:]:
        e = e + model.weight[row]
    return e.astype(np.float64)


def forward_backward(model: Crf, e: np.ndarray, first: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of label 1, and if asked for pair marginals (n, 2, 2) of each token and the one before it
    (zeros at a text's first). e: emission log-odds; first: index of each text's first token and the end."""
    n = len(e)
    if not n:
        return np.empty(0), np.empty((0, 2, 2))
    c = -(-n // CHUNK)
    q = np.full(c * CHUNK, 0.5)
    q[:n] = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    q = np.ascontiguousarray(q.reshape(c, CHUNK).T)
    head = np.zeros(c * CHUNK, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    head[0] = True
    head[n : n + 1] = True  # what fills the last chunk is apart from the last text
    head = np.ascontiguousarray(head.reshape(c, CHUNK).T)
    m = np.exp(model.move - model.move.max())
    s = np.exp(model.start - model.start.max())
    # step[t][i, j]: from label i to label j with the emission of t
    t0, t1 = 1 - q, q
    a00, a10 = np.where(head, s[0], m[0, 0]) * t0, np.where(head, s[0], m[1, 0]) * t0
    a01, a11 = np.where(head, s[1], m[0, 1]) * t1, np.where(head, s[1], m[1, 1]) * t1
    p00, p01, p10, p11 = np.ones(c), np.zeros(c), np.zeros(c), np.ones(c)
    for t in range(CHUNK):
        p00, p01 = p00 * a00[t] + p01 * a10[t], p00 * a01[t] + p01 * a11[t]
        p10, p11 = p10 * a00[t] + p11 * a10[t], p10 * a01[t] + p11 * a11[t]
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    fa, fb, x, y = np.empty(c), np.empty(c), 0.5, 0.5
    ba, bb = np.empty(c), np.empty(c)
    l00, l01, l10, l11 = p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()
    for i in range(c):
        fa[i], fb[i] = x, y
        x, y = x * l00[i] + y * l10[i], x * l01[i] + y * l11[i]
        z = x + y
        x, y = x / z, y / z
    x, y = 0.5, 0.5
    for i in range(c - 1, -1, -1):
        ba[i], bb[i] = x, y
        x, y = l00[i] * x + l01[i] * y, l10[i] * x + l11[i] * y
        z = x + y
        x, y = x / z, y / z
    f0, f1 = np.empty((CHUNK + 1, c)), np.empty((CHUNK + 1, c))
    f0[0], f1[0] = fa, fb
    for t in range(CHUNK):
        u, v = f0[t] * a00[t] + f1[t] * a10[t], f0[t] * a01[t] + f1[t] * a11[t]
        z = u + v
        f0[t + 1], f1[t + 1] = u / z, v / z
    b0, b1 = np.empty((CHUNK, c)), np.empty((CHUNK, c))
    u, v = ba, bb
    for t in range(CHUNK - 1, -1, -1):
        b0[t], b1[t] = u, v
        u, v = a00[t] * u + a01[t] * v, a10[t] * u + a11[t] * v
        z = u + v
        u, v = u / z, v / z
    z = f0[1:] * b0 + f1[1:] * b1
    one = (f1[1:] * b1 / z).T.reshape(-1)[:n]
    if not pairs:
        return one, None
    pair = np.stack([f0[:-1] * a00 * b0, f0[:-1] * a01 * b1, f1[:-1] * a10 * b0, f1[:-1] * a11 * b1])
    pair = np.where(head, 0, pair / pair.sum(0))
    return one, pair.transpose(2, 1, 0).reshape(-1, 2, 2)[:n]


def _marginals(model: Crf, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    return forward_backward(model, e, first, pairs=False)[0]


# ---------------------------------------------------------------- training


def span_lexicon(docs: list[np.ndarray], toxic: np.ndarray, least: float = 0.005, purity: float = 0.75) -> np.ndarray:
    """Spellings that label tokens: they occur in toxic texts, far less in others, and greedily cover
    the toxic texts, or are frequent in them and all but absent elsewhere. docs: distinct spelling hashes
    of each text. least: share of toxic texts (three at least) that a spelling must add."""
    bad = [d for d, x in zip(docs, toxic, strict=True) if x]
    good = [d for d, x in zip(docs, toxic, strict=True) if not x]
    if not bad:
        return np.empty(0, U)
    vocab, back = np.unique(np.concatenate(bad), return_inverse=True)
    owner = np.repeat(np.arange(len(bad)), [len(d) for d in bad])
    df_bad = np.bincount(back, minlength=len(vocab))
    other = np.concatenate(good) if good else np.empty(0, U)
    at = np.searchsorted(vocab, other)
    at[at == len(vocab)] = 0
    df_good = np.bincount(at[vocab[at] == other], minlength=len(vocab))
    scaled = df_good * (len(bad) / max(1, len(good)))
    pure = (df_bad / (df_bad + scaled) >= purity) & (vocab != 0)
    left = np.ones(len(bad), bool)
    out = []
    while left.any():
        cover = np.where(pure, np.bincount(back[left[owner]], minlength=len(vocab)) - scaled, 0)
        best = int(cover.argmax())
        if cover[best] < max(3, least * len(bad)):
            break
        out.append(best)
        left[owner[back == best]] = False
    # words that nearly always come with others, so that the cover has no need of them
    also = (df_bad >= max(5, 4 * least * len(bad))) & (df_bad / (df_bad + scaled) >= 0.98) & (vocab != 0)
    out += np.flatnonzero(also).tolist()
    return vocab[np.unique(np.array(out, int))]


def _listed(lex: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(lex):
        return np.zeros(x.shape, bool)
    at = np.searchsorted(lex, x)
    at[at == len(lex)] = 0
    return lex[at] == x


def train_crf(first: np.ndarray, f: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 60, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Crf:
    """A CRF from labelled tokens, by AdaGrad on the conditional likelihood. first: index of each
    text's first token; f: feature numbers; label: 0 or 1 of each token."""
    model = Crf(np.zeros(FEATURES, np.float32), np.zeros((2, 2)), np.zeros(2))
    model.weight[:31] = -2.0  # what training has not seen is clean
    gw = np.full(FEATURES, 1e-3)
    gm, gs = np.full((2, 2), 1e-3), np.full(2, 1e-3)
    rng = np.random.default_rng(seed)
    n = len(first) - 1
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            count = first[rows + 1] - first[rows]
            at = np.concatenate([[0], np.cumsum(count)])
            pos = np.repeat(first[rows] - at[:-1], count) + np.arange(at[-1])
            if not len(pos):
                continue
            ff, y = f[:, pos], label[pos].astype(float)
            p, pair = forward_backward(model, _emission(model, ff), at)
            g = np.zeros(FEATURES)
            for row in ff:
                g += np.bincount(row, weights=p - y, minlength=FEATURES)
            g /= len(rows)
            gw += g * g
            model.weight -= (rate * g / np.sqrt(gw) + decay * model.weight).astype(np.float32)
            inner = np.ones(len(pos), bool)
            heads = at[:-1][count > 0]
            inner[heads] = False
            yi = y.astype(int)
            seen = np.bincount(yi[:-1][inner[1:]] * 2 + yi[1:][inner[1:]], minlength=4).reshape(2, 2)
            d = (pair.sum(0) - seen) / len(rows)
            gm += d * d
            model.move -= rate * d / np.sqrt(gm)
            p1, y1 = p[heads].sum(), y[heads].sum()
            d = np.array([y1 - p1, p1 - y1]) / len(rows)
            gs += d * d
            model.start -= rate * d / np.sqrt(gs)
    return model


def learning_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Up to ``rows`` rows (k, text, y) of each label, picked by a hash of the key, whole texts of any length. A
    key labelled twice counts with its greatest label, one of several texts with the least of them. The keys that
    are sent to the scan number 2 * rows at most. Rows with a null key, label or text aren't trained on."""
    lab = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    picked = [lab.where(cond).orderBy(F.xxhash64("k"), "k").limit(rows) for cond in ("y >= 1", "y < 1")]
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(picked, "k").groupBy("k").agg(F.min("text").alias("text"), (F.max("y") >= 1).alias("y"))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", label: str = "toxic") -> Crf:
    """A CRF from document labels. Tokens are labelled first (``span_lexicon``); without any toxic
    example, and from empty tables, the model scores everything near 0. One task fits the bounded sample
    (``learning_sample`` says what becomes of nulls and repeated keys); the driver gets the model. Equal
    texts count once, with their greatest label. Other columns are ignored."""

    def run(batches):
        rows = sorted(((k, t, y) for b in batches for k, t, y in zip(*(b.column(c).to_pylist() for c in ("k", "text", "y")), strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows], [y for *_, y in rows]))], pa.binary())], ["model"])

    made = learning_sample(docs, labels, rows, key=key, label=label).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([], [])


def fit(sample: list[str], labels: list[bool]) -> Crf:
    """A CRF from texts and their labels; equal texts count once, with their greatest label."""
    texts: dict[str, bool] = {}
    for text, y in zip(sample, labels, strict=True):
        texts[text] = y or texts.get(text, False)
    toxic = np.array(list(texts.values()), bool)
    array = pa.array(list(texts), pa.string())
    docs_spelt: list[np.ndarray] = []
    for s in slices(array):
        w = tokens(s)
        x = spellings(w)[:-1]
        docs_spelt += [np.unique(x[:, a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    lex = span_lexicon(docs_spelt, toxic)
    del docs_spelt
    feats, marks, first = [], [], [0]
    for s in slices(array):
        w = tokens(s)
        x = spellings(w)
        feats.append(features(w, x))
        marks.append(_listed(lex, x[:-1]).any(0) & np.repeat(toxic[s.first : s.first + s.rows], w.count))
        first += list(first[-1] + np.cumsum(w.count))
    if not feats:
        return Crf(np.full(FEATURES, -3, np.float32), np.zeros((2, 2)), np.zeros(2))
    f, first = np.concatenate(feats, axis=1), np.array(first)
    del feats
    model = train_crf(first, f, np.concatenate(marks))
    got = []
    for lo in range(0, len(toxic), 100):
        at = first[lo : lo + 101]
        got.append(_gather(_marginals(model, _emission(model, f[:, at[0] : at[-1]]), at - at[0]), at - at[0]))
    model.blend = _logistic(np.concatenate(got), toxic.astype(float))
    return model


def _gather(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 3): the sum of the marginals up to 6, its log after adding one, and the largest marginal.
    Marginals under 0.2 don't count in the sum, so that a long text doesn't add up to a toxic one."""
    out = np.zeros((len(first) - 1, 3))
    some = np.diff(first) > 0
    if some.any():
        total = np.add.reduceat(np.where(p >= 0.2, p, 0), first[:-1][some])
        out[some] = np.stack([np.minimum(total, 6), np.log1p(total), np.maximum.reduceat(p, first[:-1][some])], axis=1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = -2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d * min(1, 5 / np.abs(d).max())
        if np.abs(d).max() < 1e-8:
            break
    return tuple(map(float, w))


# ---------------------------------------------------------------- scoring


def _score(model: Crf, array: pa.Array, spans: bool) -> tuple[np.ndarray, list]:
    score = np.zeros(len(array))
    found: list = [[] for _ in range(len(array))] if spans else []
    for s in slices(array):
        w = tokens(s)
        p = _marginals(model, _emission(model, features(w)), w.first)
        some = w.count > 0
        got = _gather(p, w.first)
        score[s.first : s.first + s.rows] = np.where(some, 1 / (1 + np.exp(-np.clip(got @ np.array(model.blend[:-1]) + model.blend[-1], -30, 30))), 0)
        if spans:
            for i in np.flatnonzero(got[:, 2] >= 0.5):
                a, b = w.first[i], w.first[i + 1]
                hit = np.flatnonzero(p[a:b] >= 0.5)
                cut = np.flatnonzero(np.diff(hit) > 1)
                cp = points(s.data[s.starts[i] : s.starts[i + 1]])
                lo, hi = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
                found[s.first + i] = [{"start": int(x), "end": int(y)} for x, y in zip(cp[w.start[a + lo] - s.starts[i]], cp[w.end[a + hi] - s.starts[i]], strict=True)]
    return score, found


_SCORED = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def score_toxicity(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, spans) of every row. spans: code-point offsets of runs of tokens whose marginal
    is 0.5 or more. A null, empty or wordless text scores 0 and has no spans. Repeated rows are
    scored each; other columns are ignored; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            yield batch_of(_SCORED, [b.column("key"), *_score(model, b.column("text"), True)])

    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, "key long, score double, spans array<struct<start: long, end: long>>").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, model: Crf, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score ``least`` or more. Null, empty and wordless texts score 0 and
    stay; repeated rows stay or go together; an empty table stays empty."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_score(model, b.column(text), False)[0] < least))

    return docs.mapInArrow(run, docs.schema)
