"""Learners work their rows out once, however often they pass over them."""

import bisect
import random
import threading

import pytest

from kickline.operators.quantiles import medians
from kickline.plans import learning as ln
from tests.test_boosting import SCHEMA, rows

WITH_GOALS = SCHEMA + ", home_goals int, away_goals int"


def goals(n, seed):
    return [(*r, (i * 7 + seed) % 4, (i * 5) % 3) for i, r in enumerate(rows(n, seed))]


@pytest.mark.parametrize("learner", ["poisson", "logistic", "ordinal", "forest", "neural", "exact_score"])
def test_rows_are_read_for_the_two_preparing_steps_and_once_more(spark, learner):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 240
    train = spark.createDataFrame(goals(n, 1), WITH_GOALS).repartition(2, "fixture_id").mapInArrow(counted, WITH_GOALS)
    scored = ln.LEARNERS[learner](train, spark.createDataFrame(goals(60, 2), WITH_GOALS), ["a", "b", "c"])
    # the exact scores are also counted and pooled before
    assert 0 < read.value <= (5 if learner == "exact_score" else 3) * n
    got = ln.quality(scored).first()
    assert got.n == 60 and all(sum(r) == pytest.approx(1) for r in scored.select(*ln.PROBS).collect())


def test_seeds_on_shared_rows_equal_separate_fits(spark):
    train, test = (spark.createDataFrame(rows(n, s), SCHEMA) for n, s in ((300, 1), (60, 2)))
    shared = ln.seed_average(ln.forest, train, test, ["a", "b", "c"], seeds=[1, 2], trees=4)
    apart = ln.average([ln.forest(train, test, ["a", "b", "c"], seed=s, trees=4) for s in (1, 2)])
    a, b = ({r.fixture_id: tuple(r[p] for p in ln.PROBS) for r in d.collect()} for d in (shared, apart))
    assert a.keys() == b.keys() and len(a) == 60 and all(a[k] == pytest.approx(b[k]) for k in a)


def test_seeds_are_fitted_side_by_side(spark):
    train, test = (spark.createDataFrame(rows(n, s), SCHEMA) for n, s in ((120, 1), (30, 2)))
    both = threading.Barrier(2, timeout=60)

    def learner(*args, **kw):
        both.wait()   # breaks if one fit waits for the other
        return ln.forest(*args, **kw)

    got = ln.seed_average(learner, train, test, ["a", "b", "c"], seeds=[1, 2], trees=2).collect()
    assert len(got) == 30 and all(sum(r[p] for p in ln.PROBS) == pytest.approx(1) for r in got)


def test_medians_of_all_columns_in_one_pass(spark):
    rng = random.Random(5)
    made = [(rng.gauss(0, 1), float(i % 7), None if i % 3 else float("nan") if i % 2 else 2.0 * i, None) for i in range(5000)]
    df = spark.createDataFrame(made, "a double, b double, c double, d double").repartition(3)
    got = medians(df, ["a", "b", "c", "d"])
    a, c = sorted(r[0] for r in made), sorted(r[2] for r in made if r[2] is not None and r[2] == r[2])
    assert abs(bisect.bisect(a, got["a"]) - 2500) <= 5 and got["b"] == 3.0 and got["d"] is None
    assert got["c"] == c[(len(c) - 1) // 2]   # few numbers: exact
    assert medians(df.filter("a > 100"), ["a"]) == {"a": None}


def test_imputers_take_the_medians_without_a_search_of_their_own(spark, monkeypatch):
    searched = []
    fit = ln.Imputer._fit
    monkeypatch.setattr(ln.Imputer, "_fit", lambda self, df: (searched.append(df.count()), fit(self, df))[1])
    train = spark.createDataFrame(rows(300, 1), SCHEMA)
    filled = ln.prepare(train, ["a", "b", "c"], True).stages[0].transform(train)
    c = sorted(r.c for r in train.collect() if r.c is not None)
    assert searched == [1] and filled.filter("c IS NULL").select("c__f").distinct().collect() == [(c[(len(c) - 1) // 2],)]
