"""One-variable maximum likelihood, and the bootstrap interval of an AUC."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kickline.operators import compare as cmp
from kickline.operators import likelihood as lk


def test_maximise_finds_the_top_and_the_ends():
    assert lk.maximise(lambda x: (-(x - 0.3), -1.0), -1, 1, 0.0) == pytest.approx(0.3)
    assert lk.maximise(lambda x: (1.0, 0.0), -1, 1, 0.0) == 1 and lk.maximise(lambda x: (-1.0, 0.0), -1, 1, 0.0) == -1
    steep = lambda x: (1 / x - 50, -1 / x ** 2)  # noqa: E731  Newton leaves the bracket from the right
    assert lk.maximise(steep, 1e-6, 10, 9.0) == pytest.approx(0.02)


SCORES = "home_goals long, away_goals long, lam double, mu double"


def sampled(rho: float, n: int = 6000):
    rng, rows = random.Random(8), []
    for _ in range(n):
        lam, mu = rng.uniform(0.8, 1.6), rng.uniform(0.7, 1.4)
        cells = {}
        for x in range(8):
            for y in range(8):
                t = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
                cells[x, y] = t * math.exp(-lam - mu) * lam ** x * mu ** y / math.factorial(x) / math.factorial(y)
        (x, y), = rng.choices(list(cells), list(cells.values()))
        rows.append((x, y, lam, mu))
    return rows


@pytest.mark.parametrize("rho", [-0.12, 0.1])
def test_rho_has_the_sign_of_the_truth_and_beats_its_neighbours(spark, rho):
    rows = sampled(rho)
    got = lk.fit_rho(spark.createDataFrame(rows, SCORES), "lam", "mu", "home_goals", "away_goals")
    assert got == pytest.approx(rho, abs=0.05) and got * rho > 0

    def likelihood(r):
        return sum(math.log({(0, 0): 1 - m * l * r, (0, 1): 1 + l * r, (1, 0): 1 + m * r, (1, 1): 1 - r}.get((x, y), 1.0)) for x, y, l, m in rows)
    assert likelihood(got) > max(likelihood(got - 1e-4), likelihood(got + 1e-4))


def test_rho_stays_inside_its_bounds(spark):
    rows = [(0, 0, 2.0, 2.0)] * 50 + [(1, 1, 0.5, 0.5)] * 3   # the likelihood rises to the lower end, where no other row stops it
    got = lk.fit_rho(spark.createDataFrame(rows, SCORES), "lam", "mu", "home_goals", "away_goals")
    assert got == pytest.approx(-0.4) and lk.fit_rho(spark.createDataFrame([(3, 2, 1.0, 1.0)], SCORES), "lam", "mu", "home_goals", "away_goals") == 0
    assert lk.fit_rho(spark.createDataFrame([], SCORES), "lam", "mu", "home_goals", "away_goals") == 0


def test_temperature_undoes_sharpening(spark):
    rng, rows = random.Random(3), []
    for _ in range(5000):
        p = [rng.uniform(0.1, 1) for _ in range(3)]
        p = [x / sum(p) for x in p]
        (y,) = rng.choices(["away", "draw", "home"], p)
        sharp = [x ** 2 for x in p]
        rows.append((y, *[x / sum(sharp) for x in sharp]))
    df = spark.createDataFrame([*rows, (None, .2, .3, .5), ("home", None, .5, .5)], "result string, p_away double, p_draw double, p_home double")
    assert lk.fit_temperature(df, lk.class_columns(), "result") == pytest.approx(2.0, rel=0.08)
    sure = spark.createDataFrame([("home", .1, .2, .7)] * 5, df.schema)
    assert lk.fit_temperature(sure, lk.class_columns(), "result") == pytest.approx(lk.T_MIN)
    assert lk.fit_temperature(df.limit(0), lk.class_columns(), "result") == 1


def test_auc_interval_against_the_closed_form(spark):
    n = 2000
    high = lambda share: [1.0] * int(share * n) + [0.0] * (n - int(share * n))
    rows = [(s, True) for s in high(0.7)] + [(s, False) for s in high(0.4)]
    df = spark.createDataFrame([*rows, (None, True)], "s double, y boolean").repartition(5)
    got = cmp.auc_interval(df, "s", F.col("y")).first()
    sd = math.sqrt((0.7 * 0.3 + 0.4 * 0.6) / n) / 2   # of (hits - false alarms + 1) / 2
    assert got.auc == pytest.approx(0.65) and got.n_pos == got.n_neg == n
    assert got.ci_low == pytest.approx(0.65 - 1.96 * sd, abs=0.15 * sd) and got.ci_high == pytest.approx(0.65 + 1.96 * sd, abs=0.15 * sd)
    again = cmp.auc_interval(df.repartition(2), "s", F.col("y")).first()
    assert again == got and cmp.auc_interval(df, "s", F.col("y"), seed=1).first().ci_low != got.ci_low


def test_auc_interval_over_ranges_of_scores(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(1.0 if y else 0.0, 1), bool(y)) for y in (i % 3 == 0 for i in range(1500))]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = cmp.auc_interval(df, "s", F.col("y"), n_boot=400).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    v10 = [sum(p > q for q in neg) / len(neg) for p in pos]
    v01 = [sum(p > q for p in pos) / len(pos) for q in neg]
    spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1) / len(v)
    sd = math.sqrt(spread(v10) + spread(v01))
    assert (got.ci_high - got.ci_low) / 3.92 == pytest.approx(sd, rel=0.15) and got.ci_low < got.auc < got.ci_high
