"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lithos.plans import boxes, corpus, documents, extra, pages, stores

SF = Path("/root/testdata/sf0.001")
QUERIES = corpus.QUERIES | boxes.QUERIES | extra.QUERIES | documents.QUERIES | pages.QUERIES | stores.QUERIES
SQL = corpus.SQL | boxes.SQL | extra.SQL | documents.SQL | pages.SQL | stores.SQL
pytestmark = pytest.mark.skipif(not SF.exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in SF.iterdir():
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 8) if isinstance(v, (bool, int, float)) or hasattr(v, "dtype") else v

    cols = sorted(df.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, str(SF)).toPandas()) == rows(duck.execute(SQL[name]).df())


# ---------------------------------------------------------------- queries without SQL, in plain Python


def test_every_query_is_checked():
    assert set(QUERIES) - set(SQL) == {"nms_greedy", "reading_order_full", "workflow_replay"}  # in test_reading and test_whole


def images(duck):
    out = {}
    for image, idx, *box in duck.execute(f"WITH {boxes.BOXES} SELECT image, idx, x1, y1, x2, y2, score FROM b ORDER BY image, idx").fetchall():
        out.setdefault(image, []).append((idx, *box))
    return out


def test_nms_greedy(spark, duck):
    want = set()
    for image, rows in images(duck).items():
        kept = []
        for idx, x1, y1, x2, y2, _ in sorted(rows, key=lambda r: (-r[5], r[0])):
            for k, a1, b1, a2, b2 in kept:
                both = max(0, min(x2, a2) - max(x1, a1)) * max(0, min(y2, b2) - max(y1, b1))
                if k % 2 == idx % 2 and both > 0.2 * ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - both):
                    break
            else:
                kept.append((idx, x1, y1, x2, y2))
        want |= {(image, k[0], k[0] % 2) for k in kept}
    assert {tuple(r) for r in boxes.nms_greedy(spark, str(SF)).collect()} == want
