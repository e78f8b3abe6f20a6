"""Language identification by error-correcting output codes.

Every language gets a codeword; one linear classifier on hashed character n-grams learns each bit.
A text's margins come from one pass, and the codeword of least logistic loss wins; a runner-up that
is nearly as close makes the answer ambiguous.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _LOWER, U, SpanHasher, batch_of, slices

#: Rows that training may use in expectation: of each language, and of all, which many languages share evenly.
TRAIN_ROWS, TRAIN_ALL = 400, 8000
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)


@dataclass
class Ecoc:
    names: list[str]
    codes: np.ndarray  # (languages, bits) of -1 and 1
    weight: np.ndarray  # (BUCKETS, bits) float32
    bias: np.ndarray
    margin: float = 0.5


def codewords(k: int) -> np.ndarray:
    """Exhaustive codes for up to six classes: 2^(k-1) - 1 bits, any two rows 2^(k-2) apart. Beyond,
    the rows of a Hadamard matrix with at least twice as many columns as classes."""
    if k == 1:
        return np.ones((1, 1), int)
    if k <= 6:
        cols = [[1, *(1 if (b >> i) & 1 else -1 for i in range(k - 1))] for b in range((1 << (k - 1)) - 1)]
        return np.array(cols).T
    n = 1
    h = np.ones((1, 1), int)
    while n < 2 * k:
        h, n = np.block([[h, h], [h, -h]]), 2 * n
    return h[1 : k + 1, 1:]


def _grams(s) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket numbers of the character n-grams, and the index of each row's first."""
    data = _LOWER[s.data]
    head = np.flatnonzero((data & 0xC0) != 0x80)
    head = np.union1d(head, s.starts[:-1][np.diff(s.starts) > 0]) if len(head) else head  # broken UTF-8 starts anew
    h = SpanHasher(data)
    ends = np.append(head, len(data))
    at = np.searchsorted(head, s.starts)
    out = []
    for n in ORDERS:
        count = np.maximum(np.diff(at) - n + 1, 0)
        if n == 1:
            pos = np.arange(len(head))
        else:
            ok = np.ones(len(head), bool)
            for j in range(1, n):
                last = at[1:] - j
                ok[last[last >= at[:-1]]] = False
            pos = np.flatnonzero(ok)
        g = h(head[pos], ends[pos + n])
        out.append((((g + U(n)) >> U(37)) & U(BUCKETS - 1), np.concatenate([[0], np.cumsum(count)])))
    return out


def margins(model_weight: np.ndarray, bias: np.ndarray, array: pa.Array) -> np.ndarray:
    """(rows, bits): the mean weight of a text's n-grams plus the bias."""
    out = np.tile(bias, (len(array), 1)).astype(np.float64)
    for s in slices(array, 1 << 19):
        total = np.zeros((s.rows, len(bias)))
        n = np.zeros(s.rows)
        for g, at in _grams(s):
            some = np.diff(at) > 0
            if some.any():
                total[some] += np.add.reduceat(model_weight[g.astype(np.int64)], at[:-1][some], axis=0)
                n += np.diff(at)
        out[s.first : s.first + s.rows] += total / np.maximum(n, 1)[:, None]
    return out


def learning_sample(docs: DataFrame, lang: str, rows: int, every: int) -> DataFrame | None:
    """(text, lang) of about ``rows`` rows of each language, ``every`` of all at most in expectation, picked by a
    hash of the text, whole texts of any length; equal rows count once. Counts, of different texts within some
    per cent, cover all rows."""
    usable = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r.lang: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return None
    mine = min(rows, every / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, mine / n))])
    even = (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 11) / F.lit(float(1 << 53))).cast("double")
    return usable.where(even < share[F.col("lang")]).distinct()


_COUNTS = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.float32()))])


def _histograms(array: pa.Array):
    """The n-gram counts of each text, over BUCKETS."""
    for s in slices(array):
        grams = _grams(s)
        for i in range(s.rows):
            yield sum((np.bincount(g[at[i] : at[i + 1]].astype(np.int64), minlength=BUCKETS) for g, at in grams), np.zeros(BUCKETS, np.int64)).astype(np.float32)


def _count_rows(batches):
    for b in batches:
        for lang, x in zip(b.column("lang").to_pylist(), _histograms(b.column("text")), strict=True):
            at = np.flatnonzero(x)
            yield batch_of(_COUNTS, [[lang], [at.astype(np.int32)], [x[at]]])


def train_langid(docs: DataFrame, lang: str = "lang", rows: int = TRAIN_ROWS, every: int = TRAIN_ALL, steps: int = 300) -> Ecoc:
    """Texts of the sample are counted where they are; one task fits the model on the counts, whose size is
    bounded by the number of rows; the driver gets its weights. Rows with a null text or language aren't
    trained on; without any, the model knows no language."""
    sample = learning_sample(docs, lang, rows, every)
    if sample is None:
        return fit([], [])

    def run(batches):
        langs, at, count = [], [], []
        for b in batches:
            langs += b.column("lang").to_pylist()
            for name, out in (("at", at), ("count", count)):
                v = b.column(name)
                offs, flat = np.asarray(v.offsets), np.asarray(v.values)
                out += [flat[x:y].copy() for x, y in zip(offs[:-1], offs[1:], strict=True)]
        order = sorted(range(len(langs)), key=lambda i: (langs[i], at[i].tobytes(), count[i].tobytes()))
        x = np.zeros((len(langs), BUCKETS), np.float32)
        for row, i in enumerate(order):
            x[row, at[i]] = count[i]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_counts(x, [langs[i] for i in order], steps))], pa.binary())], ["model"])

    counted = sample.mapInArrow(_count_rows, "lang string, at array<int>, count array<float>")
    made = counted.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([], [])


def fit(texts: list[str], langs: list[str], steps: int = 300) -> Ecoc:
    """A model from texts and their languages."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, h in enumerate(_histograms(pa.array(texts, pa.string()))):
        x[i] = h
    return fit_counts(x, langs, steps)


def fit_counts(x: np.ndarray, langs: list[str], steps: int = 300) -> Ecoc:
    """Logistic regression of each bit on n-gram shares, by full-batch Adam. x: counts (rows, BUCKETS), overwritten."""
    names = sorted(set(langs))
    if not names:
        return Ecoc([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    codes = codewords(len(names))
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = 1 / (np.sqrt((x * x).mean(0)) + 1e-4)
    scale *= 1 / np.sqrt(np.count_nonzero(x, axis=1).mean() + 1)
    x *= scale
    y = codes[np.searchsorted(names, langs)].astype(np.float32)
    w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        g = -(x.T @ (y * p)) / len(x) + 1e-4 * w
        gb = -(y * p).mean(0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= (0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)).astype(np.float32)
        b -= (0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)).astype(np.float32)
    return Ecoc(names, codes, np.ascontiguousarray(w * scale[:, None]), b)


def decode(model: Ecoc, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding of margins: index of the nearest codeword, its share of exp(-loss), and
    whether the runner-up's loss is within ``margin``."""
    loss = np.logaddexp(0, -f[:, None, :] * model.codes[None]).sum(2)
    best = loss.argmin(1)
    e = np.exp(-(loss - loss.min(1, keepdims=True)))
    score = 1 / e.sum(1)
    if loss.shape[1] > 1:
        two = np.partition(loss, 1, axis=1)
        close = two[:, 1] - two[:, 0] < model.margin
    else:
        close = np.zeros(len(f), bool)
    return best, score, close


_OUT = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def identify(docs: DataFrame, model: Ecoc, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row. Texts that are null or hold no letter, and all
    texts if the model knows no language, are ``und`` with score 0. Other columns are ignored;
    repeated rows are each returned; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            pred, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            letter = np.asarray(b.column("letter"))
            if n and letter.any() and model.names:
                rows = np.flatnonzero(letter)
                f = margins(model.weight, model.bias, b.column("text").take(pa.array(rows)) if len(rows) < n else b.column("text"))
                best, p, c = decode(model, f)
                pred[rows] = np.array(model.names, object)[best]
                score[rows], close[rows] = p, c
            yield batch_of(_OUT, [b.column("key"), pa.array(pred.tolist(), pa.string()), score, close])

    text_ = F.col(text).cast("string")
    base = docs.select(F.col(key).cast("long").alias("key"), text_.alias("text"), F.coalesce(text_.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return base.mapInArrow(run, "key long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)
