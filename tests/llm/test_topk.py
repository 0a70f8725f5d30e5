"""Exact top-k search against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, slot string, part string, cells string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["?"] * 5) for i, v in rows], SCHEMA)


def run(spark, rows, k=3, **sizes):
    df = frame(spark, rows).repartition(3)
    out = ts.exact_top_k(df, df.where(F.col("vec_id") % 20 == 0), k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: tuple((x is None, x) for x in r))


def plain(rows, k=3):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(use):
        if q is None or q % 20:
            continue
        hits = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i is None, i or 0)
                      for m, (i, b) in enumerate(use) if m != n)[:k]
        out += [(q, r, None if bare else i, -s) for r, (s, bare, i) in enumerate(hits, 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def sparse_rows(seed, count=300, dims=12):
    rng = np.random.default_rng(seed)
    cells = rng.normal(0, 0.2, (count, dims)) * (rng.random((count, dims)) < 0.3)
    return [(int(i) - 40, [float(x) for x in v]) for i, v in enumerate(cells)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search_on_sparse_and_dense_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(ts, "BLOCK_CELLS", 12 * 17)
    monkeypatch.setattr(ts, "QUERY_ROWS", 4)
    monkeypatch.setattr(ts, "SCORE_CELLS", 40)
    rows = sparse_rows(seed)
    rows += [(1000 + i, [0.4] * 12) for i in range(60)]  # ties everywhere
    assert run(spark, rows, k=7) == plain(rows, k=7)


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.25]), (20, [0.5, -0.25]), (20, [0.5, -0.25]), (20, [1.0, 1.0]), (None, [0.5, -0.25]),
            (None, [2.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]),
            (5, []), (40, []), (6, [0.5]), (7, [0.5, -0.25, 9.0]), (-20, [-0.001, 0.0]), (8, [1e15, -1e15])]
    assert run(spark, rows, k=4) == plain(rows, k=4)


def test_values_of_every_width_are_exact(spark):
    rows = [(i * 10, [float(3**i), -float(2**i), 1.0]) for i in range(-3, 36)]
    assert run(spark, rows, k=5) == plain(rows, k=5)


def test_fewer_rows_than_asked_for_and_empty(spark):
    assert run(spark, [(0, [1.0]), (3, [2.0])], k=9) == [(0, 1, 3, 128 * 64)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, []) == []


def test_lists_keep_places_only_where_rare():
    cells = np.array([[1, 0, 0, 0], [1, 2, 3, 0], [0, 0, 0, 0]], np.int8)
    kinds = [(term, places is None) for term, places, _ in ts.postings(cells)]
    assert kinds == [(0, False), (1, True)]
    weights = np.array([[2, 1, 5], [0, 3, 0]], np.int64)
    assert (ts.accumulate(weights, ts.postings(cells), 4) == weights @ cells.astype(np.int64)).all()


def test_many_groups_share_the_work(spark, monkeypatch):
    """No group holds more than its slot of candidates, and equal vectors change nothing about that."""
    monkeypatch.setattr(ts, "BLOCK_CELLS", 8)
    monkeypatch.setattr(ts, "SLOT_BLOCKS", 1)
    seen = []
    meet = ts._meet
    monkeypatch.setattr(ts, "_meet", lambda k: seen.append(k) or meet(k))
    rows = [(i, [0.5, 0.5]) for i in range(60)]
    assert run(spark, rows, k=3) == plain(rows, k=3)
    assert seen == [3]
