"""Boosted trees with early stopping."""

import random

import pytest

from kickline.plans import learning as ln

SCHEMA = "season int, gameweek int, fixture_id long, result string, label double, a double, b double, c double"


def rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        label = 0 if a + rng.gauss(0, 1) > 0.4 else 2 if b + rng.gauss(0, 1) > 0.4 else 1
        out.append((2000, 1 + i // 10, i, ln.CL[label], float(label), a, b, None if i % 17 == 0 else c))
    return out


def test_rounds_are_chosen_on_validation_rows(spark):
    train, valid, test = (spark.createDataFrame(rows(n, s), SCHEMA) for n, s in ((400, 1), (300, 2), (300, 3)))
    best, losses = ln.early_stop(train, valid, ["a", "b", "c"], patience=6, step=0.4, rounds=60)
    assert losses[best - 1] == min(losses) < losses[0] and (len(losses) == 60 or len(losses) >= best + 6)
    _, limited = ln.early_stop(train, valid, ["a", "b", "c"], patience=60, step=0.4, rounds=5)
    assert len(limited) == 5   # the limit comes before the patience
    scored, rounds, _ = ln.boosted_early(train, valid, test, ["a", "b", "c"], patience=6, step=0.4, rounds=60)
    got = ln.quality(scored).first()
    assert 1 <= rounds <= 60 and got.n == 300 and got.accuracy > 0.5 and got.log_loss < 1.0
    assert all(sum(r) == pytest.approx(1) for r in scored.select(*ln.PROBS).collect())


class Curve:
    """A fitted model whose validation loss is least after `best` rounds."""

    def __init__(self, rounds, best):
        self.rounds, self.best = rounds, best

    def evaluateEachIteration(self, held):
        return [float(abs(i - self.best)) for i in range(1, self.rounds + 1)]


@pytest.mark.parametrize("best, runs", [(20, [125]), (40, [125, 157]), (110, [125, 250]), (180, [125, 250, 313]), (300, [125, 250, 500])])
def test_repeated_runs_are_as_long_as_the_patience_asks(spark, monkeypatch, best, runs):
    asked, parts = [], set()

    def fit(fitted, make):
        asked.append(make().getMaxIter())
        parts.add(fitted.rdd.getNumPartitions())
        return [Curve(asked[-1], best) for _ in ln.CL]

    monkeypatch.setattr(ln, "_per_class", fit)
    train, valid = (spark.createDataFrame(rows(80, s), SCHEMA).repartition(8, "fixture_id") for s in (1, 2))
    found, losses = ln.early_stop(train, valid, ["a", "b", "c"])
    assert found == best and asked == runs and len(losses) == runs[-1]
    assert parts == {1}   # few rows are no work for many tasks
