"""Ordered operators against plain Python, with one key holding a third of the rows and more."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.operators import operations as ops
from topicloom.operators import ordered as o

START = datetime(2024, 1, 1)


def skewed(n=1200, seed=1, ties=False):
    """Rows (id, user, ts, value): user 7 holds over a third, with ties half of it at one time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 7 if rng.random() < 0.45 else rng.randrange(40)
        at = START + timedelta(seconds=rng.randrange(5000))
        if ties and user == 7 and rng.random() < 0.5:
            at = START + timedelta(seconds=900)
        rows.append((i, user, at, rng.choice([None, *range(20)])))
    rng.shuffle(rows)
    return rows


SCHEMA = "id long, user long, ts timestamp_ntz, value long"


def by_user(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_row_frames(spark, ties, hot_rows):
    rows = skewed(ties=ties)
    df = spark.createDataFrame(rows, SCHEMA)
    out = o.over_last_rows(df, ["user"], ["ts", "id"], 3, {
        "n": lambda w: F.count("value").over(w.rowsBetween(-3, 0)),
        "s": lambda w: F.sum("value").over(w.rowsBetween(-3, 0)),
        "back": lambda w: F.lag("id", 3).over(w)}, hot_rows=hot_rows)
    want = {}
    for group in by_user(rows).values():
        for i, row in enumerate(group):
            known = [r[3] for r in group[max(0, i - 3):i + 1] if r[3] is not None]
            want[row[0]] = (len(known), sum(known) if known else None,
                            group[i - 3][0] if i >= 3 else None)
    got = {r["id"]: (r["n"], r["s"], r["back"]) for r in out.collect()}
    assert got == want
    assert out.columns == ["id", "user", "ts", "value", "n", "s", "back"]


@pytest.mark.parametrize("ties", [False, True])
def test_hot_keys_are_cut_into_bounded_chunks(spark, ties):
    df = spark.createDataFrame(skewed(ties=ties), SCHEMA)
    split = o.split_hot(df, ["user"], ["ts", "id"], hot_rows=100)
    assert len(split.hot) == 1
    sizes = split.rows.groupBy("user", o.CHUNK).count().where("user = 7").collect()
    assert len(sizes) > 5
    assert max(r["count"] for r in sizes) <= 110
    assert split.rows.where("user <> 7").select(o.CHUNK).distinct().count() == 1


def test_no_hot_key_adds_nothing_to_the_plan(spark):
    df = spark.createDataFrame(skewed(200), SCHEMA)
    out = o.over_last_rows(df, ["user"], ["ts", "id"], 1, {"b": lambda w: F.lag("id").over(w)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window") == 1


@pytest.mark.parametrize("hot_rows", [40, 10**9])
@pytest.mark.parametrize("cut", [1, 300, 700])
def test_seed_rows_come_first(spark, hot_rows, cut):
    rows = sorted(skewed(900, seed=3), key=lambda r: (r[2], r[0]))
    early, late = rows[:cut], rows[cut:]
    seed = []
    for group in by_user(early).values():
        seed += group[-2:]
    out = o.over_last_rows(
        spark.createDataFrame(late, SCHEMA), ["user"], ["ts", "id"], 2,
        {"n": lambda w: F.count("*").over(w.rowsBetween(-2, 0)),
         "back": lambda w: F.lag("id", 2).over(w)},
        seed=spark.createDataFrame(seed, SCHEMA), hot_rows=hot_rows)
    late_ids = {r[0] for r in late}
    want = {}
    for group in by_user(rows).values():
        for i, row in enumerate(group):
            if row[0] in late_ids:
                want[row[0]] = (min(i + 1, 3), group[i - 2][0] if i >= 2 else None)
    assert {r["id"]: (r["n"], r["back"]) for r in out.collect()} == want


@pytest.mark.parametrize("keys", [["user"], []])
@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_running_sums(spark, keys, hot_rows):
    rows = skewed(ties=True)
    df = spark.createDataFrame(rows, SCHEMA)
    out = o.running_sums(df, keys, ["ts", "id"], {"place": F.lit(1), "total": F.col("value")},
                         hot_rows=hot_rows)
    groups = by_user(rows).values() if keys else [sorted(rows, key=lambda r: (r[2], r[0]))]
    want = {}
    for group in groups:
        total = None
        for i, row in enumerate(group):
            if row[3] is not None:
                total = (total or 0) + row[3]
            want[row[0]] = (i + 1, total)
    assert {r["id"]: (r["place"], r["total"]) for r in out.collect()} == want


@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_ranks(spark, hot_rows):
    rows = skewed()
    out = o.ranks(spark.createDataFrame(rows, SCHEMA), ["user"], "value", hot_rows=hot_rows)

    def place(v):
        return (v is not None, v or 0)  # nulls first

    want = {}
    for group in by_user(rows).values():
        values = [place(r[3]) for r in group]
        for row in group:
            v = place(row[3])
            want[row[0]] = (1 + sum(x < v for x in values),
                            1 + len({x for x in values if x < v}))
    assert {r["id"]: (r["rank"], r["dense_rank"]) for r in out.collect()} == want


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_asof_join(spark, ties, hot_rows):
    rows = skewed(1500, seed=5, ties=ties)
    left, right = rows[:500], rows[500:800]  # few right rows: carried over many chunks
    left = left + [(9999, None, START, 1)]
    right = right + [(9998, None, START, 1)]
    out = o.asof_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA),
                      ["user"], "ts", "ts", {"id": "seen", "value": "seen_value"}, tie="id",
                      hot_rows=hot_rows)
    want = {}
    for row in left:
        seen = [r for r in right if r[1] == row[1] and r[1] is not None and r[2] <= row[2]]
        best = max(seen, key=lambda r: (r[2], r[0]), default=None)
        want[row[0]] = (best[0], best[3]) if best else (None, None)
    assert {r["id"]: (r["seen"], r["seen_value"]) for r in out.collect()} == want
    assert out.columns == ["id", "user", "ts", "value", "seen", "seen_value"]


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_status_changes(spark, hot_rows):
    rng = random.Random(11)
    states = ["RUNNING", "running", "UNASSIGNED", "FAILED", None]
    rows = [(r[0], r[1], r[2], rng.choice(states)) for r in skewed(800, seed=9)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz, status string")
    out = ops.status_changes(df, ["user"], ["ts", "id"], "status", hot_rows=hot_rows)
    want = set()
    for group in by_user(rows).values():
        for before, row in zip(group, group[1:]):
            old, new = before[3], row[3] or "LOST"
            if old is None or old.upper() == new.upper():
                continue
            if (old.upper(), new.upper()) != ("RUNNING", "UNASSIGNED"):
                want.add((row[0], old, new))
    assert {(r["id"], r["old_status"], r["new_status"]) for r in out.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 50])
@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_ntiles(spark, n, hot_rows):
    rows = skewed(400)
    out = o.ntiles(spark.createDataFrame(rows, SCHEMA), ["user"], ["ts", "id"], n,
                   hot_rows=hot_rows)
    want = {}
    for group in by_user(rows).values():
        base, extra = divmod(len(group), n)
        sizes = [base + 1] * extra + [base] * (n - extra)
        tiles = [i + 1 for i, size in enumerate(sizes) for _ in range(size)]
        want |= {row[0]: tile for row, tile in zip(group, tiles)}
    assert {r["id"]: r["ntile"] for r in out.collect()} == want


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_except_all(spark, hot_rows):
    rows = skewed(700)
    df = spark.createDataFrame(rows, SCHEMA)
    taken = [(7,)] * 100 + [(1,)] * 2 + [(99,)] + [(2,)] * 10_000
    out = o.except_all(df, spark.createDataFrame(taken, "user long"), ["user"], ["ts", "id"],
                       hot_rows)
    want = Counter(r[1] for r in rows) - Counter(k for k, in taken)
    assert Counter(r["user"] for r in out.collect()) == want


def test_sampled_detection_finds_the_hot_key(spark, monkeypatch):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user"),
        F.col("id").alias("at"))
    hot, rows = o.hot_keys(df, ["user"], hot_rows=20_000)
    assert len(hot) == 1 and 0.7 * 66_668 < rows < 1.3 * 66_668
    monkeypatch.setattr(o, "SAMPLES", 20)
    out = o.running_sums(df, ["user"], ["at"], {"n": F.lit(1)}, hot_rows=20_000)
    assert out.where("user = 7").agg(F.max("n"), F.count("*")).first() == (66_668, 66_668)
    assert out.where("user <> 7").agg(F.max("n")).first()[0] == 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 5))), min_size=1,
                max_size=60), st.integers(1, 4), st.integers(2, 12))
def test_any_small_table_agrees_with_the_plain_window(spark, pairs, back, hot_rows):
    rows = [(i, k, t) for i, (k, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, k long, t long")
    exprs = {"n": lambda w: F.count("id").over(w.rowsBetween(-back, 0)),
             "b": lambda w: F.lag("id", back).over(w)}
    hot = o.over_last_rows(df, ["k"], ["t", "id"], back, exprs, hot_rows=hot_rows)
    plain = o.over_last_rows(df, ["k"], ["t", "id"], back, exprs)
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)", "string", "timestamp", "date"])
def test_order_of_any_type_is_cut_right(spark, kind):
    """Values a double cannot tell apart, texts and times; the second column runs the other way."""
    rows = [(i, i % 2, 2**62 + i // 3, -i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, v long, w long")
    value = {"long": F.col("v"), "decimal(38,0)": F.col("v").cast("decimal(38,0)") * 10**15,
             "string": F.concat(F.lit("t"), F.col("v").cast("string")),
             "timestamp": F.timestamp_seconds(F.col("v") - 2**62),
             "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("v") - 2**62).cast("int"))}[kind]
    df = df.withColumn("v", value)
    exprs = {"n": lambda w: F.lag("id", 2).over(w)}
    hot = o.over_last_rows(df, ["k"], ["v", "w"], 2, exprs, hot_rows=40)
    plain = o.over_last_rows(df, ["k"], ["v", "w"], 2, exprs)
    assert o.split_hot(df, ["k"], ["v", "w"], hot_rows=40).hot
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_asof_tie_keeps_its_type(spark, hot_rows):
    left = spark.createDataFrame([(1, 5)] * 4, "k long, at long")
    right = spark.createDataFrame([(1, 5, 2**60 + i) for i in (2, 0, 1)], "k long, at2 long, id long")
    out = o.asof_join(left, right, ["k"], "at", "at2", {"id": "found"}, tie="id", hot_rows=hot_rows)
    assert {r["found"] for r in out.collect()} == {2**60 + 2}


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_intersect_all(spark, hot_rows):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2, 2, 3, None, None])], "k long, i long")
    right = spark.createDataFrame([(1,), (1,), (1,), (1,), (2,), (4,), (None,)], "k long")
    got = o.intersect_all(left, right, ["k"], ["i"], hot_rows).select("k").collect()
    assert Counter(r["k"] for r in got) == Counter({1: 4, 2: 1, None: 1})
