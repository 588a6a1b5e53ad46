import math
import random

import pytest
from pyspark.sql import functions as F

from kickline.functions import goals, text
from kickline.operators import betting as bet
from kickline.operators import calendar as cal
from kickline.operators import checks as ck
from kickline.operators import compare as cmp
from kickline.operators import decision as dec
from kickline.operators import scoring as sc
from kickline.operators.quantiles import exact_percentiles
from kickline.operators.windows import DAY_US

P = "p_away double, p_draw double, p_home double, result string"


def test_near_misses_cost_less_in_the_ordinal_score(spark):
    df = spark.createDataFrame([(0.0, 0.4, 0.6, "home"), (0.4, 0.0, 0.6, "home")], P)
    p = sc.probs("p")
    rows = df.select(sc.rps_term(F.col("result"), *p).alias("rps"), sc.log_loss_term(sc.prob_of(F.col("result"), *p)).alias("ll")).collect()
    assert [round(r.rps, 6) for r in rows] == [0.08, 0.16]
    assert rows[0].ll == rows[1].ll == pytest.approx(0.5108, abs=1e-4)


def test_argmax_tie_orders_and_threshold(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4, "home"), (0.2, 0.3, 0.5, "home"), (0.25, 0.45, 0.30, "draw")], P)
    p = sc.probs("p")
    got = df.select(sc.argmax_class(*p).alias("a"), sc.market_argmax(*p).alias("m"),
                    dec.draw_threshold(0.30, *p).alias("t"), dec.draw_threshold(0.50, *p).alias("u")).collect()
    assert [r.a for r in got] == ["away", "home", "draw"]
    assert [r.m for r in got] == ["home", "home", "draw"]
    assert [r.t for r in got] == ["away", "draw", "draw"]   # the threshold is inclusive
    assert got[2].u == "home"                               # below it the draw is out even when it is the maximum


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(0.1, 0.3, 0.6, "home")], P)
    got = {r.cls: r.bin for r in sc.reliability(df, "result").collect()}
    assert got == {"away": 1, "draw": 3, "home": 6}


def binomial_p(a, b):
    n, m = a + b, min(a, b)
    return 1.0 if a == b else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2 ** n)


def test_sign_test_is_exact(spark):
    pairs = [(0, 0), (1, 0), (5, 5), (3, 12), (40, 22), (450, 520), (900, 1000)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", cmp.sign_test_p(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(binomial_p(r.a, r.b), rel=1e-9)


def test_promotion_reasons(spark):
    rows = [("same", True, True)] * 20 + [("few", True, False)] * 3 + [("many", True, False)] * 30 + [("many", False, True)] * 5 + [("loses", False, True)] * 9
    df = spark.createDataFrame(rows, "g string, a boolean, b boolean")
    got = {r.g: r.reason for r in cmp.promotion(cmp.mcnemar(df, ["g"], "a", "b")).collect()}
    assert got == {"same": "identical", "few": "not_significant", "many": "promote", "loses": "does_not_win"}


def test_auc_with_ties_against_pairs(spark, tiny_blocks):
    rng = random.Random(3)
    rows = [(rng.choice([0.1, 0.2, 0.3, 0.4, 0.5]), rng.random() < 0.4) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert sc.auc(df, [], "s", F.col("y")).first().auc == pytest.approx(want)


def test_percentile_interpolates(spark, tiny_blocks):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 10)] + [("b", float(x)) for x in range(101)], "g string, v double")
    got = {r.g: (r.n, round(r.p95, 6), r.top) for r in exact_percentiles(df, ["g"], "v", {"p95": 0.95, "top": 1.0}).collect()}
    assert got == {"a": (3, 9.2, 10.0), "b": (101, 95.0, 100.0)}


def test_fair_odds_have_no_edge_and_drawdown_starts_at_zero(spark, tiny_blocks):
    fair = spark.createDataFrame([("S", 1, 1, 0.25, 0.25, 0.5, 4.0, 4.0, 2.0, "home")],
                                 "season string, gameweek int, fixture_id long, p_away double, p_draw double, p_home double, odds_away double, odds_draw double, odds_home double, result string")
    assert bet.candidates(fair, 0.0).count() == 0
    rng = random.Random(8)
    gains = [rng.choice([-1.0, -1.0, 2.5]) for _ in range(90)]
    df = spark.createDataFrame([("k", i, g) for i, g in enumerate(gains)], "k string, t long, gain double")
    peak = cum = worst = 0.0
    for g in gains:
        cum += g
        peak = max(peak, cum)
        worst = max(worst, peak - cum)
    assert bet.drawdown(df, ["k"], ["t"]).first().max_drawdown == pytest.approx(worst)


def test_score_grid(spark):
    df = spark.createDataFrame([(1.4, 1.1)], "lam double, mu double")
    plain = goals.with_outcome_probs(df, "lam", "mu").first()
    lifted = goals.with_outcome_probs(df, "lam", "mu", -0.1).first()
    assert plain.p_away + plain.p_draw + plain.p_home == pytest.approx(1.0)
    pmf = lambda k, m: math.exp(-m) * m ** k / math.factorial(k)
    cells = {(x, y): pmf(x, 1.4) * pmf(y, 1.1) for x in range(11) for y in range(11)}
    assert plain.p_draw == pytest.approx(sum(p for (x, y), p in cells.items() if x == y) / sum(cells.values()))
    assert lifted.p_draw > plain.p_draw


def test_names(spark):
    reg = spark.createDataFrame([("MCI", "Manchester City"), ("MUN", "Manchester United"), ("IPS", "Ipswich Town"), ("NFO", "Nott'm Forest")], "short_name string, team_name string")
    names = spark.createDataFrame([("Manchester Utd.",), ("Ipswich",), ("  nottm  FOREST ",), ("City",), ("Spurs",), ("Unknown FC",)], "raw_name string")
    got = {r.raw_name.strip(): (r.short_name, r.how) for r in text.resolve_names(names, reg, {"Spurs": "TOT"}).collect()}
    assert got["Manchester Utd."] == ("MUN", "exact") and got["Ipswich"] == ("IPS", "stripped")
    assert got["nottm  FOREST"] == ("NFO", "exact") and got["Spurs"] == ("TOT", "alias")
    assert got["City"][0] is None and got["Unknown FC"] == (None, "unresolved")
    with pytest.raises(text.UnmappedName, match="City.*Unknown FC"):
        text.require_resolved(text.resolve_names(names, reg, {"Spurs": "TOT"}))


def test_postponed_match_stops_blocking(spark):
    d = DAY_US
    rows = [(2020, 1, 1, 0, True), (2020, 1, 2, 0, False), (2020, 2, 3, 5 * d, True), (2020, 3, 4, 30 * d, False)]
    fx = spark.createDataFrame(rows, "season int, gameweek int, fixture_id long, kick long, done boolean")
    early = {r.gameweek: r for r in cal.gameweek_status(fx, F.col("done"), 6 * d).collect()}
    late = {r.gameweek: r for r in cal.gameweek_status(fx, F.col("done"), 20 * d).collect()}
    assert early[1].situation == "in_progress" and early[1].n_pending == 1 and not early[3].final
    assert late[1].n_pending == 0 and late[3].final
    assert cal.next_predictable(cal.gameweek_status(fx, F.col("done"), 20 * d)).first().next_gameweek == 3


def test_gates_find_injected_violations(spark):
    src = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 5)], "season int, gameweek int, t long")
    dl = spark.createDataFrame([(1, 1, 20), (1, 2, 30)], "season int, gameweek int, deadline long")
    assert ck.after_deadline(src, "t", dl, ["season", "gameweek"]).count() == 1   # exactly at the deadline is too late
    with pytest.raises(ck.LeakageError):
        ck.gate(ck.after_deadline(src, "t", dl, ["season", "gameweek"]), "late", ck.LeakageError)
    ck.gate(src.filter("t < 0"), "nothing")
    assert ck.banned_columns(src.withColumn("xP", F.lit(1))) == ["xP"]
    with pytest.raises(ck.QualityError):
        ck.require_contract(src, ["season", "absent"])
