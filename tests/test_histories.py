"""Histories that outgrow a window's frame or a task: the same results, without copies and sliding frames."""

import random

import pytest
from pyspark.sql import functions as F

from kickline.operators.calendar import last_before, slot_of
from kickline.operators.checks import rows_available
from kickline.operators.squad import squad_windows
from kickline.operators.windows import DAY_US, trailing_day_counts
from kickline.sources import silver
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=["whole", "blocks"])
def either(request, spark):
    return request.getfixturevalue("tiny_blocks") if request.param == "blocks" else spark


def test_trailing_days_keep_rows_without_a_time_or_key(either, spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), i) for i in range(90)]
    rows = [(k, None if t is None else t * DAY_US // 2, i) for k, t, i in rows]
    out = trailing_day_counts(spark.createDataFrame(rows, "k string, t long, id long"), ["k"], "t", {"d1": 1, "d3": 3})
    got = {r.id: (r.k, r.t, r.d1, r.d3) for r in out.collect()}
    for k, t, i in rows:
        of = [r[1] for r in rows if r[0] == k]
        want = [sum(1 for x in of if x is None) if t is None else sum(1 for x in of if x is not None and t - n * DAY_US < x <= t) for n in (1, 3)]
        assert got[i] == (k, t, *want)
    assert len(got) == len(rows)


def test_trailing_days_of_wanted_rows_equal_those_of_all(either, spark):
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), i // 2 if i < 30 else i) for i in range(90)]
    rows = [(k, None if t is None else t * DAY_US // 2, i) for k, t, i in [*rows, rows[-1], rows[-1]]]
    df, days = spark.createDataFrame(rows, "k string, t long, id long"), {"d1": 1, "d3": 3}
    some = trailing_day_counts(df, ["k"], "t", days, wanted=F.col("id") % 3 == 2)
    every = trailing_day_counts(df, ["k"], "t", days).filter("id % 3 = 2")
    assert some.dtypes == every.dtypes and sorted(map(repr, some.collect())) == sorted(map(repr, every.collect()))


def test_trailing_days_have_no_sliding_frame(spark):
    df = spark.createDataFrame([("a", 1, 1)], "k string, t long, id long")
    frames = plan(trailing_day_counts(df, ["k"], "t", {"d7": 7}))
    assert "RangeFrame, unboundedpreceding" in frames and "RangeFrame, -" not in frames


def test_squad_windows_against_brute_force(either, spark):
    rng = random.Random(12)
    ordered = [(1, 100 * t + k, f"T{t}", k) for t in range(3) for k in range(20)]
    apps = [(1, f, team, rng.choice(["p", "q", "r", "s", None]), rng.randrange(0, 90)) for _, f, team, _ in ordered for _ in range(rng.randrange(0, 5))]
    out = squad_windows(spark.createDataFrame(apps, "season int, fixture_id int, team string, player string, minutes long"),
                        spark.createDataFrame(ordered, "season int, fixture_id int, team string, k long"))
    assert "sequence(" not in plan(out)   # no appearance is copied into later matches
    got = {r.fixture_id: (r.minutes_hhi, r.squad_continuity) for r in out.collect()}
    assert len(got) == len(ordered)
    for _, f, team, k in ordered:
        window = [f - i for i in range(5) if k - i >= 0]
        m, here = {}, {p for _, g, _, p, x in apps if g == f and x > 0}
        for _, g, _, p, x in apps:
            if g in window and x > 0:
                m[p] = m.get(p, 0) + x
        t = sum(m.values())
        hhi = sum(x * x for x in m.values()) / (t * t) if m else None
        kept = sum(m[p] for p in here) / t if here else None
        assert got[f] == (pytest.approx(hhi) if m else None, pytest.approx(kept) if here else None)


def test_rows_available_against_brute_force(spark):
    rng = random.Random(13)
    at = [rng.choice([None, *range(30)]) for _ in range(200)]
    due = [(i, x) for i, x in enumerate([None, 0, 7, 7, 12, 40, -3])]
    out = rows_available(spark.createDataFrame([(x,) for x in at], "t long"), "t", spark.createDataFrame(due, "g int, d long"), "d")
    assert "Window" not in plan(out)   # no order over all source instants
    got = {r.g: (r.n_available, r.n_later) for r in out.collect()}
    for g, d in due:
        n = sum(1 for x in at if x is not None and d is not None and x < d)
        assert got[g] == (n, len(at) - n)


def test_last_rows_before_instants(spark):
    rng = random.Random(14)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(120)] + [("a", None, 500)]
    cuts = [3, 10, 11, 30]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    assert {r.t: r.s for r in df.select("t", slot_of("t", cuts).alias("s")).collect() if r.t is not None} == {t: sum(c <= t for c in cuts) for _, t, _ in rows if t is not None}
    got = {(r.k, r.t, r.i) for r in last_before(df, ["k"], ["t", "i"], cuts).collect()}
    for k in "ab":
        for c in cuts:
            seen = [(t, i) for x, t, i in rows if x == k and t is not None and t < c]
            assert not seen or (k, *max(seen)) in got
    assert len(got) <= 2 * (len(cuts) + 1) and df.select(slot_of("t", []).alias("s")).filter("s = 0").count() == len(rows)


def test_players_are_not_written_and_grouped_by_match_in_place(spark):
    p = silver.player(spark, SMALL).groupBy("season", "fixture_id").agg(F.count(F.lit(1)).alias("n"))
    assert not [k for k in silver._staged if k[2] == "player"]
    p.collect()
    shown = p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "l_tax" not in shown and "l_discount" not in shown
