"""Overlap joins, substring lineage, quantiles, user-defined aggregates, sketches, sessions and SQL models."""

import math
import pickle
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.functions.udfs import user_aggregate
from topicloom.operators import aggregates as agg
from topicloom.operators import joins as j
from topicloom.operators import models as md
from topicloom.session import fresh_dir


def spans(seed, count, names):
    rng = random.Random(seed)
    for i in range(count):
        start = rng.randrange(-5000, 5000)
        yield (i, None if rng.random() < 0.03 else start,
               start + rng.choice([0, 0, 1, 5, 64, 1000, 10**6, 3 * 10**8, -1]))


@pytest.mark.parametrize("seed", [1])
def test_overlaps_of_any_length(spark, seed):
    a, b = list(spans(seed, 150, "a")), list(spans(seed + 9, 150, "b"))
    left = spark.createDataFrame(a, "i long, f long, t long")
    right = spark.createDataFrame(b, "k long, x long, y long")
    out = j.overlap_join(left, right, (F.col("f"), F.col("t")), (F.col("x"), F.col("y")))
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["i"], r["k"]) for r in out.collect())
    whole = lambda rows: [r for r in rows if r[1] is not None and r[1] <= r[2]]
    assert got == sorted((p[0], q[0]) for p in whole(a) for q in whole(b) if p[1] <= q[2] and q[1] <= p[2])


def test_overlap_with_nothing(spark):
    none = spark.createDataFrame([], "i long, f long, t long")
    some = spark.createDataFrame([(1, 2, 3)], "k long, x long, y long")
    assert j.overlap_join(none, some, (F.col("f"), F.col("t")), (F.col("x"), F.col("y"))).count() == 0


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_totals_of_overlaps_without_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(j, "NODE_ROWS", few)
    ends = [(-2**63, 2**63 - 1), (2**63 - 1, 2**63 - 1), (-2**63, -2**63), (-1, 0), (-2**63, 0), (7, None), (5, 2)]
    a = [(i % 90, f, t) for i, f, t in spans(3, 120, "a")] + [(None if k == 3 else 90 + k, *e) for k, e in enumerate(ends)]
    b = [(i, i % 7 or None, f, t) for i, f, t in spans(4, 120, "b")] + [(200 + k, k, *e) for k, e in enumerate(ends)]
    left = spark.createDataFrame(a + [a[5]], "i long, f long, t long")
    right = spark.createDataFrame(b, "k long, v long, x long, y long")
    out = j.overlap_join(left, right, (F.col("f"), F.col("t")), (F.col("x"), F.col("y")), per=["i"], totals={
        "n": ("count", "*"), "known": ("count", "v"), "all": ("sum", "v"), "least": ("min", "v"), "most": ("max", "k")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = {}
    for i, f, t in [*a, a[5]]:
        for k, v, x, y in b:
            if None not in (f, t, x, y) and f <= t and x <= y and f <= y and x <= t:
                want.setdefault(i, []).append((k, v))
    whole = lambda pairs: [v for _, v in pairs if v is not None]
    assert {r["i"]: tuple(r)[1:] for r in out.collect()} == {
        i: (len(p), len(whole(p)), sum(whole(p)) if whole(p) else None, min(whole(p), default=None), max(k for k, _ in p))
        for i, p in want.items()}


def test_totals_of_overlaps_with_nothing(spark):
    none = spark.createDataFrame([], "i long, f long, t long")
    some = spark.createDataFrame([(1, 2, 3)], "k long, x long, y long")
    sides = [(none, some, "f t x y i"), (some, none, "x y f t k")]
    for left, right, names in sides:
        f, t, x, y, per = names.split()
        out = j.overlap_join(left, right, (F.col(f), F.col(t)), (F.col(x), F.col(y)), per=[per],
                             totals={"n": ("count", "*")})
        assert out.columns == [per, "n"] and out.count() == 0


def test_substring_lineage(spark):
    names = ["a", "ab", "abc", "abcd", "abcde", "bcdeabcde", "zz", "", "größe", "abcde"]
    settings = [("abcdeabcde", "xaby"), ("größer", None), (None, None), ("", "zzz"), ("a", "a")]
    tasks = spark.createDataFrame([(i, {"topics": s, "topic": o}) for i, (s, o) in enumerate(settings)],
                                  "id long, config map<string,string>")
    topics = spark.createDataFrame([(n,) for n in names], "topic string")
    out = j.substring_lineage(tasks, "config", ["topics", "topic"], topics)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(
        {(i, n) for i, pair in enumerate(settings) for n in names if n and any(n in s for s in pair if s)})


@pytest.mark.parametrize("few", [20, 10**6])
def test_quantiles_are_exact(spark, few):
    rng = random.Random(4)
    rows = [("skewed", 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(400)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2]))) for _ in range(300)] + [(None, 5.0), (None, 6.0)]
    rows += [("odd", None), ("odd", math.nan), ("odd", -0.5), ("none", None)]
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    got = sorted(map(tuple, agg.quantiles(df, ["k"], "x", shares, few).collect()), key=str)
    want = []
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        want += [(key, s, values[max(1, math.ceil(s * len(values))) - 1]) for s in shares if values]
    assert got == sorted(want, key=str)


def moments():
    """A class made here travels to the workers by value."""
    class Moments:
        """Count, sum and sum of squares, then mean and variance."""

        def init(self):
            return np.zeros(3)

        def update(self, state, rows):
            x = rows["x"].dropna()
            return state + [len(x), x.sum(), (x * x).sum()]

        def merge(self, state, other):
            return state + other

        def finish(self, state):
            n, total, squares = state.tolist()
            return (int(n), total / n if n else None, squares / n - (total / n) ** 2 if n else None)

    return Moments()


def test_user_aggregate_never_gathers_a_group(spark):
    rows = [("hot", float(i % 10)) for i in range(4000)] + [("cold", 2.0), (None, 4.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(40)
    out = user_aggregate(df, ["k"], ["x"], moments(), "n long, mean double, variance double")
    got = {r["k"]: (r["n"], r["mean"], r["variance"]) for r in out.collect()}
    assert got == {"hot": (4000, 4.5, 8.25), "cold": (1, 2.0, 0.0), None: (1, 4.0, 0.0), "empty": (0, None, None)}
    assert user_aggregate(df.limit(0), ["k"], ["x"], moments(), "n long, mean double, variance double").count() == 0
    whole = user_aggregate(df, [], ["x"], moments(), "n long, mean double, variance double").collect()
    assert [r["n"] for r in whole] == [4002]


def test_sketches_merge_over_any_union(spark):
    rows = [(day, i % 5000 + day * 1000) for day in range(6) for i in range(8000)]
    kept = agg.sketches(spark.createDataFrame(rows, "day int, v long"), ["day"], "v")
    for days in ([0], [1, 2], [0, 3, 5], range(6)):
        want = len({v for d, v in rows if d in days})
        got = agg.merge_sketches(kept.where(F.col("day").isin(list(days))), []).first()
        assert got["parts"] == len(list(days)) and abs(got["distinct"] - want) <= 0.065 * want


@pytest.mark.parametrize("hot_rows", [30, 10**9])
def test_sessions_of_a_hot_key(spark, hot_rows):
    rng, start, rows = random.Random(6), datetime(2024, 1, 1), []
    for key, n in ((1, 400), (2, 20), (None, 15)):
        at = start
        for _ in range(n):
            at += timedelta(seconds=rng.choice([0, 10, 59, 60, 61, 600]))
            rows.append((key, at))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz").repartition(4)
    want = []
    for key in (1, 2, None):
        times, part = sorted(t for k, t in rows if k == key), []
        for t in times:
            if part and (t - part[-1]).total_seconds() >= 60:
                want.append((key, part[0], part[-1], len(part)))
                part = []
            part.append(t)
        want.append((key, part[0], part[-1], len(part)))
    got = agg.sessions(df, "ts", 60, ["k"], hot_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_model_as_sql_function(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["it's", "b\\c", "d"]), rng.randrange(9), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "label string, x int, y double")
    store = md.Models(spark, fresh_dir(spark, "models"))
    store.save("kinds", md.naive_bayes_pipeline("label", ["x", "y"], 100, df), udf="kind_of")
    assert store.register("kinds") == "kind_of"
    scored = store.score(df, "kinds").select("predicted", F.expr("kind_of(x, y)").alias("said"))
    assert scored.where("predicted <> said OR said IS NULL").count() == 0
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(LookupError):
        store.register("unknown")


def test_states_survive_pickling():
    state = pickle.loads(pickle.dumps(moments().update(moments().init(), pd.DataFrame({"x": [1.0, None]}))))
    assert moments().finish(state) == (1, 1.0, 0.0)
