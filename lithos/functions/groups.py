"""Many small groups through Python in few calls: sorted partitions are read as a stream of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]], inputs: list[str], added: str = "", together: bool = False) -> DataFrame:
    """For each group, fn gets the columns ``inputs`` in ``order`` and returns the places of the rows to keep and
    new columns for them. With ``together`` it gets the rows of many groups and the number of each row's group. One group at most is carried from
    batch to batch; a group is held whole. Rows that already lie together by some of the keys are not dealt again: a window asks for that, as repartition can't."""
    names = df.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *([added] if added else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            edges = _edges(pdf)
            if len(edges) > 1:
                yield _done(pdf, edges)
            held = pdf.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield _done(held, np.array([0, len(held)]))

    def _edges(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def _done(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        cols = {c: pdf[c].to_numpy()[: edges[-1]] for c in inputs}
        if together:
            keep, new = fn(cols, np.repeat(np.arange(len(edges) - 1), np.diff(edges)))
            return pdf.iloc[keep].assign(**new)
        rows, more = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            keep, new = fn({c: v[lo:hi] for c, v in cols.items()})
            rows.append(lo + keep)
            more.append(new)
        out = pdf.iloc[np.concatenate(rows)]
        return out.assign(**{c: np.concatenate([m[c] for m in more]) for c in (more[0] if more else {})})

    dealt = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n > 0").select(*names)
    return dealt.mapInPandas(run, schema)
