"""Cutting of lines from texts: only rows with cuts are read, and those as plain Python would."""

import random

import numpy as np
import pyarrow as pa

from lithos.llm import linededup as L
from lithos.llm.tokens import SpanHasher, slices

CUT = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("prev", pa.list_(pa.int64())), ("next", pa.list_(pa.int64()))]))


def plain(text: str, cuts: list) -> tuple[str, list]:
    (s,) = slices(pa.array([text]))
    a, b, _, _ = L.lines(s)
    h = SpanHasher(s.data)(a, b).view(np.int64).tolist()
    gone = set()
    for c in cuts:
        lo, hi = c["lo"], c["hi"]
        for want in c["prev"]:
            if lo == 0 or h[lo - 1] != want:
                break
            lo -= 1
        for want in c["next"]:
            if hi == len(a) or h[hi] != want:
                break
            hi += 1
        gone |= set(range(lo, hi))
    raw, out, spans, end = text.encode(), b"", [], 0
    for i in range(len(a)):
        start, stop = int(a[i]), int(a[i + 1]) if i + 1 < len(a) else len(raw)
        if i in gone:
            out, p, q = out + raw[end:start], len(raw[:start].decode()), len(raw[:stop].decode())
            if spans and spans[-1]["end"] == p:
                spans[-1]["end"] = q
            else:
                spans.append({"start": p, "end": q})
            end = stop
    out += raw[end:]
    return (out.rstrip() if spans and end == len(raw) else out).decode(), spans


def test_cuts_are_those_of_plain_python_and_other_rows_are_not_read(monkeypatch):
    rng = random.Random(3)
    texts: list = [None, "", "one. two", "  \n"]
    todo: list = [None, None, None, None]
    for _ in range(60):
        text = rng.choice(["", " \n"]) + "".join(rng.choice(["é a", "b", "c d", "雨"]) + rng.choice([".", "!"]) + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randint(1, 9)))
        (s,) = slices(pa.array([text]))
        a, b, *_ = L.lines(s)
        h, cuts = SpanHasher(s.data)(a, b).view(np.int64).tolist(), []
        for _ in range(rng.randint(0, 3)):
            lo = rng.randrange(len(a))
            hi = rng.randint(lo + 1, len(a))
            some = lambda x: [v if rng.random() < 0.8 else 5 for v in x[: rng.randint(0, 4)]] + [7] * rng.randint(0, 2)
            cuts.append({"lo": lo, "hi": hi, "prev": some(h[:lo][::-1]), "next": some(h[hi:])})
        texts.append(text)
        todo.append(cuts or None)
    want = [(t, []) if not c else plain(t, c) for t, c in zip(texts, todo, strict=True)]
    read, lines = [], L.lines
    monkeypatch.setattr(L, "lines", lambda s: read.append(s.rows) or lines(s))
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(todo, CUT)], ["k", "text", "todo"])
    got = [r for b in L._cutter("text", "todo", ["k", "text"], "removed")(iter([whole.slice(0, 0), whole.slice(0, 4), whole.slice(4, 9), whole.slice(13)])) for r in b.to_pylist()]
    assert [(r["text"], r["removed"]) for r in got] == want and [r["k"] for r in got] == list(range(len(texts)))
    assert sum(read) == sum(c is not None for c in todo) < len(texts) - 10
