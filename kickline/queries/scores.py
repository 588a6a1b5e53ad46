"""Scoring and comparison (M-*), decisions and betting (D-*)."""

from pyspark.sql import functions as F

from kickline.functions import goals
from kickline.functions.market import implied, overround, shift_draw
from kickline.operators import betting as bet
from kickline.operators import compare as cmp
from kickline.operators import decision as dec
from kickline.operators import scoring as sc
from kickline.operators.joins import sized_broadcast
from kickline.operators.quantiles import exact_percentiles
from kickline.plans import monitoring as mon
from kickline.queries.base import query
from kickline.queries.columns import _LAM, _MU, rate_cols
from kickline.queries.joins import _LABEL, played_until
from kickline.queries.windows import rounded
from kickline.sources import registry as reg
from kickline.sources import silver

CL = sc.CLASSES
P, Q = _LABEL.format(p="p"), _LABEL.format(p="q")
PA = "CASE result WHEN 'away' THEN p_away WHEN 'draw' THEN p_draw ELSE p_home END"
RULE = "CASE WHEN p_draw >= {t} THEN 'draw' WHEN p_away >= p_home THEN 'away' ELSE 'home' END"


def labelled(spark, sf):
    f = silver.forecast(spark, sf)
    return f.withColumns({"said": sc.argmax_class(*sc.probs("p")), "said_q": sc.argmax_class(*sc.probs("q"))})


def _cm_sql(src, group, pred="said", actual="result"):
    """class metrics in SQL from one grouped confusion count"""
    cells = ", ".join(f"count(*) FILTER (WHERE {actual} = '{a}' AND {pred} = '{b}') AS n_{a}_{b}" for a in CL for b in CL)
    parts = []
    for c in CL:
        said = " + ".join(f"n_{a}_{c}" for a in CL)
        was = " + ".join(f"n_{c}_{b}" for b in CL)
        parts += [f"coalesce(n_{c}_{c} / nullif({said}, 0), 0) AS precision_{c}", f"coalesce(n_{c}_{c} / nullif({was}, 0), 0) AS recall_{c}",
                  f"coalesce(2 * n_{c}_{c} / nullif({said} + {was}, 0), 0) AS f1_{c}"]
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    acc = " + ".join(f"n_{c}_{c}" for c in CL)
    macro = ", ".join(f"round(({' + '.join(f'{m}_{c}' for c in CL)}) / 3, 6) AS {m}_macro" for m in ("precision", "recall", "f1"))
    per = ", ".join(f"round({m}_{c}, 6) AS {m}_{c}" for c in CL for m in ("precision", "recall", "f1"))
    return f"""cm AS (SELECT {g}count(*) AS n, {cells} FROM {src} {by}), pc AS (SELECT {g}n, ({acc}) / n AS accuracy, {', '.join(parts)} FROM cm),
    metrics AS (SELECT {g}n, round(accuracy, 6) AS accuracy, {macro}, {per} FROM pc)"""


def _round_metrics(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(("accuracy", "precision", "recall", "f1"))})


@query("m01_class_metrics", f"WITH l AS (SELECT *, {P} AS said FROM fx_pred), {_cm_sql('l', 'season')} SELECT * FROM metrics")
def m01(spark, sf):
    return _round_metrics(sc.class_metrics(labelled(spark, sf), ["season"], "said", "result"))


@query("m02_confusion_matrix", f"SELECT result, " + ", ".join(f"count(*) FILTER (WHERE {P} = '{c}') AS {c}" for c in CL) + " FROM fx_pred GROUP BY result")
def m02(spark, sf):
    return labelled(spark, sf).groupBy("result").pivot("said", list(CL)).count().fillna(0)


@query("m03_log_loss", f"SELECT season, round(avg(-ln(least(greatest({PA}, 1e-15), 1))), 6) AS log_loss FROM fx_pred GROUP BY season")
def m03(spark, sf):
    p = sc.prob_of(F.col("result"), *sc.probs("p"))
    return silver.forecast(spark, sf).groupBy("season").agg(F.round(F.avg(sc.log_loss_term(p)), 6).alias("log_loss"))


_RPS = "(pow(p_away - CASE WHEN result = 'away' THEN 1 ELSE 0 END, 2) + pow(p_away + p_draw - CASE WHEN result = 'home' THEN 0 ELSE 1 END, 2)) / 2"


@query("m04_ranked_probability_score", f"SELECT season, round(avg({_RPS}), 6) AS rps FROM fx_pred GROUP BY season")
def m04(spark, sf):
    t = sc.rps_term(F.col("result"), *sc.probs("p"))
    return silver.forecast(spark, sf).groupBy("season").agg(F.round(F.avg(t), 6).alias("rps"))


_U = """u0 AS (SELECT r, (r * 1103515245 + 12345) % 4294967296 AS h FROM range(2000) t(r)), u1 AS (SELECT r, (xor(h, h >> 15) * 1103515245 + 12345) % 4294967296 AS h FROM u0),
    u2 AS (SELECT r, ((xor(h, h >> 13) * 1103515245 + 12345) % 4294967296) / 4294967296.0::DOUBLE AS u FROM u1)"""


@query("m05_accuracy_bootstrap", f"""WITH b AS (SELECT count(*) AS n, avg(CASE WHEN {P} = result THEN 1.0 ELSE 0.0 END) AS p FROM fx_pred), {_U},
    k AS (SELECT n, p, CAST(unnest(range(greatest(0, CAST(floor(n * p - 10 * sqrt(n * p * (1 - p)) - 10) AS BIGINT)), least(n, CAST(ceil(n * p + 10 * sqrt(n * p * (1 - p)) + 10) AS BIGINT)) + 1)) AS BIGINT) AS k FROM b),
    f AS (SELECT n, p, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS f FROM k),
    c AS (SELECT n, p, k, sum(f) OVER (ORDER BY k) AS cdf FROM f),
    d AS (SELECT n, p, k / n AS acc FROM u2 ASOF JOIN c ON u2.u <= c.cdf)
    SELECT n, round(p, 6) AS accuracy, round(quantile_cont(acc, 0.025), 6) AS ci_low, round(quantile_cont(acc, 0.975), 6) AS ci_high FROM d GROUP BY n, p""")
def m05(spark, sf):
    out = cmp.accuracy_interval(labelled(spark, sf), F.col("said") == F.col("result"))
    return rounded(out, "accuracy", "ci_low", "ci_high")


@query("m06_reliability_curve", "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cls, p_{c} AS p, result = '{c}' AS y FROM fx_pred" for c in CL) + """)
    SELECT cls, CAST(""" + " + ".join(f"CASE WHEN p >= {i / 10} THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS observed FROM x GROUP BY 1, 2""")
def m06(spark, sf):
    return rounded(sc.reliability(silver.forecast(spark, sf), "result"), "p_mean", "observed")


def _mcn(src, group, a, b):
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""mc AS (SELECT {g}count(*) AS n, count(*) FILTER (WHERE {a} AND NOT {b}) AS n01, count(*) FILTER (WHERE NOT {a} AND {b}) AS n10, avg(CASE WHEN {a} THEN 1.0 ELSE 0.0 END) AS acc_a, avg(CASE WHEN {b} THEN 1.0 ELSE 0.0 END) AS acc_b FROM {src} {by}),
    mcp AS (SELECT mc.*, n01 + n10 AS n_discordant, CASE WHEN n01 = n10 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n01 + n10 + 1) - lgamma(j + 1) - lgamma(n01 + n10 - j + 1) - (n01 + n10) * ln(2))) FROM range(0, least(n01, n10) + 1) t(j))) END AS p_value,
      CASE WHEN n01 > n10 THEN 'a' WHEN n10 > n01 THEN 'b' ELSE 'tie' END AS winner FROM mc)"""


_MC_OUT = "n, n01, n10, n_discordant, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(p_value, 6) AS p_value, winner"


@query("m07_mcnemar_by_season", f"""WITH h AS (SELECT season, {P} = result AS a, {Q} = result AS b FROM fx_pred), {_mcn('h', 'season', 'a', 'b')} SELECT season, {_MC_OUT} FROM mcp""")
def m07(spark, sf):
    h = labelled(spark, sf).select("season", (F.col("said") == F.col("result")).alias("a"), (F.col("said_q") == F.col("result")).alias("b"))
    return rounded(cmp.mcnemar(h, ["season"], "a", "b"), "acc_a", "acc_b", "p_value")


@query("m08_promotion_decision", f"""WITH h AS (SELECT season, {P} = result AS a, {Q} = result AS b FROM fx_pred), {_mcn('h', 'season', 'a', 'b')},
    r AS (SELECT season, CASE WHEN n_discordant = 0 THEN 'identical' WHEN winner <> 'a' THEN 'does_not_win' WHEN p_value >= 0.05 THEN 'not_significant' WHEN acc_a < acc_b THEN 'worse_on_holdout' ELSE 'promote' END AS reason FROM mcp)
    SELECT season, reason, reason = 'promote' AS promote FROM r""")
def m08(spark, sf):
    h = labelled(spark, sf).select("season", (F.col("said") == F.col("result")).alias("a"), (F.col("said_q") == F.col("result")).alias("b"))
    t = cmp.promotion(cmp.mcnemar(h, ["season"], "a", "b"), holdout_a="acc_a", holdout_b="acc_b")
    return t.select("season", "reason", "promote")


@query("o06_recent_gameweeks", f"""SELECT season, gameweek, count(*) AS n, count(*) FILTER (WHERE {P} = result) AS hits FROM fx_pred JOIN (SELECT DISTINCT season, gameweek FROM fx_pred ORDER BY season DESC, gameweek DESC LIMIT 10) USING (season, gameweek) GROUP BY ALL""")
def o06(spark, sf):
    r = cmp.recent_gameweeks(labelled(spark, sf), 10)
    return r.groupBy("season", "gameweek").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == F.col("result")).alias("hits"))


def _auc_sql(c, score):
    return f"""SELECT '{c}' AS cls, (sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM
      (SELECT result = '{c}' AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM fx_pred)"""


@query("m09_one_vs_rest_auc", "SELECT cls, round(auc, 6) AS auc FROM (" + " UNION ALL ".join(_auc_sql(c, f"p_{c}") for c in CL) + ")")
def m09(spark, sf):
    long = silver.forecast(spark, sf).select("result", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(f"p_{c}").alias("p")) for c in CL])).alias("x")).select("result", "x.*")
    return sc.auc(long, ["cls"], "p", F.col("result") == F.col("cls")).select("cls", F.round("auc", 6).alias("auc"))


@query("m10_auc_bootstrap")
def m10(spark, sf):
    f = silver.forecast(spark, sf)
    return rounded(cmp.auc_interval(f, "p_draw", F.col("result") == "draw"), "auc", "ci_low", "ci_high")


@query("m11_brier_per_class", "SELECT season, " + ", ".join(f"round(avg(pow(p_{c} - CASE WHEN result = '{c}' THEN 1 ELSE 0 END, 2)), 6) AS brier_{c}" for c in CL) + " FROM fx_pred GROUP BY season")
def m11(spark, sf):
    return silver.forecast(spark, sf).groupBy("season").agg(*[
        F.round(F.avg(F.pow(F.col(f"p_{c}") - (F.col("result") == c).cast("double"), F.lit(2.0))), 6).alias(f"brier_{c}") for c in CL])


@query("m12_decile_table", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_draw, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM fx_pred),
    b AS (SELECT p_draw, result, CAST(len([e2 FOR e2 IN edges IF p_draw > e2]) AS INT) AS decile FROM fx_pred, e)
    SELECT decile, count(*) AS n, round(avg(p_draw), 6) AS p_mean, round(avg(CASE WHEN result = 'draw' THEN 1.0 ELSE 0.0 END), 6) AS observed FROM b GROUP BY decile""")
def m12(spark, sf):
    f = silver.forecast(spark, sf)
    return rounded(mon.quantile_table(f, "p_draw", F.col("result") == "draw", 10), "p_mean", "observed")


@query("m13_confidence_bands", f"""WITH c AS (SELECT greatest(p_away, p_draw, p_home) AS top, CASE WHEN {P} = result THEN 1.0 ELSE 0.0 END AS hit FROM fx_pred)
    SELECT CAST(floor(top * 20) AS INT) AS band, count(*) AS n, round(avg(top), 6) AS confidence, round(avg(hit), 6) AS accuracy, round((SELECT corr(top, hit) FROM c), 6) AS correlation FROM c GROUP BY 1""")
def m13(spark, sf):
    c = labelled(spark, sf).select(F.greatest(*sc.probs("p")).alias("top"), (F.col("said") == F.col("result")).cast("double").alias("hit"))
    bands = c.groupBy(F.floor(F.col("top") * 20).cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("top"), 6).alias("confidence"), F.round(F.avg("hit"), 6).alias("accuracy"))
    return bands.crossJoin(c.agg(F.round(F.corr("top", "hit"), 6).alias("correlation")))   # one row


@query("m14_baseline_always_home", "SELECT season, count(*) AS n, round(avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM fx_match GROUP BY season")
def m14(spark, sf):
    return (silver.match(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"),
            F.round(F.avg((F.col("result") == "home").cast("double")), 6).alias("accuracy")))


@query("m15_baseline_class_prior", """WITH t AS (SELECT """ + ", ".join(f"avg(CASE WHEN result = '{c}' THEN 1.0 ELSE 0.0 END) AS prior_{c}" for c in CL) + """ FROM fx_match WHERE season < 2000)
    SELECT season, count(*) AS n, round(avg(-ln(CASE result WHEN 'away' THEN prior_away WHEN 'draw' THEN prior_draw ELSE prior_home END)), 6) AS log_loss,
    round(avg(CASE WHEN result = CASE WHEN prior_away >= prior_draw AND prior_away >= prior_home THEN 'away' WHEN prior_draw >= prior_home THEN 'draw' ELSE 'home' END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM fx_match, t WHERE season >= 2000 GROUP BY season""")
def m15(spark, sf):
    m = silver.match(spark, sf)
    return rounded(mon.class_prior_baseline(m.filter(F.col("season") < 2000), m.filter(F.col("season") >= 2000), ["season"], "result"), "log_loss", "accuracy")


_MK = "SELECT season, result, " + ", ".join(f"1 / odds_{c} / (1 / odds_home + 1 / odds_draw + 1 / odds_away) AS m_{c}" for c in CL) + ", 1 / odds_home + 1 / odds_draw + 1 / odds_away AS over FROM fx_match WHERE odds_home IS NOT NULL"
_MKHIT = "CASE WHEN result = CASE WHEN m_home >= m_draw AND m_home >= m_away THEN 'home' WHEN m_draw >= m_away THEN 'draw' ELSE 'away' END THEN 1.0 ELSE 0.0 END"
_MKLL = "-ln(CASE result WHEN 'away' THEN m_away WHEN 'draw' THEN m_draw ELSE m_home END)"


@query("m16_baseline_market", f"WITH k AS ({_MK}) SELECT count(*) AS n, round(avg({_MKHIT}), 6) AS accuracy, round(avg({_MKLL}), 6) AS log_loss, round(avg(over), 6) AS mean_overround FROM k")
def m16(spark, sf):
    return rounded(mon.market_baseline(silver.match(spark, sf), [], "result"), "accuracy", "log_loss", "mean_overround").drop("draw_rate", "acc_home")


@query("m17_baselines_per_season", f"""WITH k AS ({_MK}) SELECT coalesce(CAST(season AS VARCHAR), 'ALL') AS season, count(*) AS n, round(avg(CASE WHEN result = 'draw' THEN 1.0 ELSE 0.0 END), 6) AS draw_rate,
    round(avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END), 6) AS acc_home, round(avg({_MKHIT}), 6) AS accuracy, round(avg({_MKLL}), 6) AS log_loss FROM k GROUP BY ROLLUP (season)""")
def m17(spark, sf):
    out = mon.market_baseline(silver.match(spark, sf), ["season"], "result", rollup=True).drop("mean_overround")
    return (rounded(out, "draw_rate", "acc_home", "accuracy", "log_loss")
            .withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("ALL"))))


def _rules_sql():
    return f"""r AS (SELECT season, gameweek, result, 'argmax' AS rule, {P} AS label, true AS prospective, p_away, p_draw, p_home FROM fx_pred
      UNION ALL SELECT season, gameweek, result, 'draw_030', {RULE.format(t=0.30)}, (season, gameweek) >= (1998, 3), p_away, p_draw, p_home FROM fx_pred)"""


@query("m18_monitoring_per_gameweek", f"""WITH {_rules_sql()} SELECT season, gameweek, rule, count(*) AS n, round(avg(CASE WHEN label = result THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE label = 'draw') AS draws,
    round(avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END), 6) AS acc_home, round(avg(greatest(p_away, p_draw, p_home)), 6) AS mean_confidence, round(avg(-ln({PA})), 6) AS log_loss, round(avg({_RPS}), 6) AS rps, bool_and(prospective) AS prospective FROM r GROUP BY ALL""")
def m18(spark, sf):
    return mon.per_gameweek(silver.forecast(spark, sf))


@query("m19_monitoring_summary", f"""WITH {_rules_sql()}, g AS (SELECT season, gameweek, rule, avg(CASE WHEN label = result THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END) AS home, avg(-ln({PA})) AS ll, count(*) AS n, count(*) FILTER (WHERE label = result) AS hits FROM r GROUP BY ALL)
    SELECT season, rule, count(*) AS gameweeks, CAST(sum(n) AS BIGINT) AS matches, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(ll), 6) AS mean_log_loss, round(avg(CASE WHEN acc > home THEN 1.0 ELSE 0.0 END), 6) AS share_won FROM g GROUP BY ALL""")
def m19(spark, sf):
    return mon.summary(silver.forecast(spark, sf))


@query("m20_prospective_vs_retrospective", f"""WITH h AS (SELECT (season, gameweek) >= (1998, 3) AS prospective, {RULE.format(t=0.30)} = result AS a, {P} = result AS b FROM fx_pred), {_mcn('h', 'prospective', 'a', 'b')} SELECT prospective, {_MC_OUT} FROM mcp""")
def m20(spark, sf):
    return rounded(mon.compare_rule(silver.forecast(spark, sf), dec.CANDIDATES[0]), "acc_a", "acc_b", "p_value")


@query("m21_disagreement_matrix", f"""WITH h AS (SELECT *, {P} AS a, {Q} AS b FROM fx_pred) SELECT season, """ + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, c in (
    ("same_label", "a = b"), ("both_hit", "a = result AND b = result"), ("only_a", "a = result AND b <> result"), ("only_b", "a <> result AND b = result"), ("both_miss", "a <> result AND b <> result")))
    + ", " + ", ".join(f"round(corr(p_{c}, q_{c}), 6) AS corr_{c}" for c in CL) + " FROM h GROUP BY season")
def m21(spark, sf):
    a, b = F.col("said") == F.col("result"), F.col("said_q") == F.col("result")
    share = {"same_label": F.col("said") == F.col("said_q"), "both_hit": a & b, "only_a": a & ~b, "only_b": ~a & b, "both_miss": ~a & ~b}
    return labelled(spark, sf).groupBy("season").agg(
        *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in share.items()],
        *[F.round(F.corr(f"p_{c}", f"q_{c}"), 6).alias(f"corr_{c}") for c in CL])


@query("m22_low_score_cells", f"""WITH r AS (SELECT {_LAM} AS lam, {_MU} AS mu, home_goals AS x, away_goals AS y FROM fx_match), c AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(cx, cy))
    SELECT CAST(cx AS VARCHAR) || '-' || CAST(cy AS VARCHAR) AS cell, count(*) FILTER (WHERE x = cx AND y = cy) AS observed, round(sum(exp(-lam) * pow(lam, cx) * exp(-mu) * pow(mu, cy)), 4) AS expected FROM r, c GROUP BY 1""")
def m22(spark, sf):
    lam, mu = rate_cols()
    r = silver.match(spark, sf).select(lam.alias("lam"), mu.alias("mu"), "home_goals", "away_goals")
    cells = [(0, 0), (0, 1), (1, 0), (1, 1)]   # fixed values
    agg = r.agg(*[F.struct(F.lit(f"{x}-{y}").alias("cell"), F.count_if((F.col("home_goals") == x) & (F.col("away_goals") == y)).alias("observed"),
                           F.round(F.sum(goals.poisson(F.lit(x), F.col("lam")) * goals.poisson(F.lit(y), F.col("mu"))), 4).alias("expected")).alias(f"c{x}{y}")
                  for x, y in cells])
    return agg.select(F.explode(F.array(*[f"c{x}{y}" for x, y in cells])).alias("r")).select("r.*")


_SEEDED = """s AS (SELECT gameweek, seed, result, CASE WHEN p_away >= d AND p_away >= p_home THEN 'away' WHEN d >= p_home THEN 'draw' ELSE 'home' END = result AS a,
      CASE WHEN q_away >= e AND q_away >= q_home THEN 'away' WHEN e >= q_home THEN 'draw' ELSE 'home' END = result AS b FROM
      (SELECT *, p_draw + 0.02 * (fixture_id % (seed + 2)) AS d, q_draw + 0.02 * (fixture_id % (seed + 2)) AS e FROM fx_pred, (VALUES (1), (2), (3)) v(seed)))"""


@query("m23_version_comparison_over_seeds", f"""WITH {_SEEDED}, g AS (SELECT *, 'all' AS subgroup FROM s UNION ALL SELECT *, CASE WHEN gameweek <= 5 THEN 'early' ELSE 'rest' END FROM s), {_mcn('g', 'subgroup, seed', 'a', 'b')}
    SELECT subgroup, count(*) AS seeds, round(avg(acc_a), 6) AS mean_a, round(stddev_samp(acc_a), 6) AS sd_a, round(avg(acc_b), 6) AS mean_b, round(stddev_samp(acc_b), 6) AS sd_b, round(min(p_value), 6) AS min_p FROM mcp GROUP BY subgroup""")
def m23(spark, sf):
    f = silver.forecast(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])))
    noise = 0.02 * (F.col("fixture_id") % (F.col("seed") + 2))
    def hit(x):
        return sc.argmax_class(F.col(f"{x}_away"), F.col(f"{x}_draw") + noise, F.col(f"{x}_home")) == F.col("result")
    groups = {"all": F.lit(True), "early": F.col("gameweek") <= 5, "rest": F.col("gameweek") > 5}
    out = mon.versions_over_seeds(f.withColumns({"a": hit("p"), "b": hit("q")}), groups)
    return rounded(out, "mean_a", "sd_a", "mean_b", "sd_b", "min_p")


@query("m24_threshold_sweep", f"""WITH t AS (SELECT unnest([0.50, 0.40, 0.35, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.20]::DOUBLE[]) AS threshold),
    x AS (SELECT threshold, result, {RULE.format(t="threshold")} AS said FROM fx_pred, t), c AS (SELECT threshold, count(*) AS n, count(*) FILTER (WHERE said = 'draw') AS draws, count(*) FILTER (WHERE said = 'draw' AND result = 'draw') AS tp, count(*) FILTER (WHERE result = 'draw') AS pos, count(*) FILTER (WHERE said = result) AS hits FROM x GROUP BY threshold)
    SELECT threshold, draws, tp, round(coalesce(tp / nullif(draws, 0), 0), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(draws + pos, 0), 0), 6) AS f1, round(hits / n, 6) AS accuracy FROM c""")
def m24(spark, sf):
    return mon.threshold_sweep(silver.forecast(spark, sf), dec.SWEEP_THRESHOLDS)


@query("m25_rule_vs_production", f"""WITH h AS (SELECT season, {RULE.format(t=0.30)} = result AS a, {P} = result AS b FROM fx_pred), {_mcn('h', 'season', 'a', 'b')} SELECT season, n, n_discordant, n01, n10, round(acc_a - acc_b, 6) AS delta, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM mcp""")
def m25(spark, sf):
    f = silver.forecast(spark, sf)
    h = f.select("season", (dec.draw_threshold(0.30, *sc.probs("p")) == F.col("result")).alias("a"), (sc.argmax_class(*sc.probs("p")) == F.col("result")).alias("b"))
    t = cmp.mcnemar(h, ["season"], "a", "b")
    return t.select("season", "n", "n_discordant", "n01", "n10", F.round(F.col("acc_a") - F.col("acc_b"), 6).alias("delta"),
                    F.round("p_value", 6).alias("p_value"), (F.col("p_value") < cmp.ALPHA).alias("significant"))


@query("m26_walk_forward_rules", f"""WITH {_rules_sql()}, g AS (SELECT rule, season, gameweek, count(*) AS n, count(*) FILTER (WHERE label = result) AS hits, count(*) FILTER (WHERE label = 'draw') AS draws FROM r GROUP BY ALL)
    SELECT rule, count(*) AS gameweeks, CAST(sum(n) AS BIGINT) AS matches, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS mean_per_gameweek, CAST(sum(draws) AS BIGINT) AS draws FROM g GROUP BY rule""")
def m26(spark, sf):
    return mon.rules_overall(silver.forecast(spark, sf))


@query("m27_post_match_evaluation", f"""WITH l AS (SELECT season, gameweek, kick, {P} AS said, CASE WHEN kick < epoch_us(TIMESTAMP '2001-07-01') THEN result END AS result FROM fx_pred), p AS (SELECT * FROM l WHERE result IS NOT NULL), {_cm_sql('p', 'season, gameweek')} SELECT * FROM metrics""")
def m27(spark, sf):
    results = silver.match(spark, sf).filter(F.col("kick") < played_until()).select("season", "fixture_id", "result")
    pred = labelled(spark, sf).drop("result")
    played = reg.with_results(pred, results, "said").filter(F.col("result").isNotNull())
    return _round_metrics(sc.class_metrics(played, ["season", "gameweek"], "said", "result"))


# -- decisions and betting -------------------------------------------------------------------------

@query("d01_argmax_label", f"SELECT season, fixture_id, {P} AS label FROM fx_pred")
def d01(spark, sf):
    return silver.forecast(spark, sf).select("season", "fixture_id", sc.argmax_class(*sc.probs("p")).alias("label"))


@query("d02_draw_threshold_rule", f"SELECT season, fixture_id, {RULE.format(t=0.26)} AS label FROM fx_pred")
def d02(spark, sf):
    return silver.forecast(spark, sf).select("season", "fixture_id", dec.draw_threshold(0.26, *sc.probs("p")).alias("label"))


@query("d03_label_all_rules", f"SELECT season, fixture_id, {P} AS prediction, {RULE.format(t=0.30)} AS pred_draw_030, 'argmax' AS production_rule FROM fx_pred")
def d03(spark, sf):
    once = dec.label_all(silver.forecast(spark, sf))
    return dec.label_all(once).select("season", "fixture_id", "prediction", "pred_draw_030", "production_rule")


@query("u09_rule_disagreements", f"SELECT season, fixture_id, {P} AS prediction, {RULE.format(t=0.30)} AS pred_draw_030 FROM fx_pred WHERE {P} <> {RULE.format(t=0.30)}")
def u09(spark, sf):
    return dec.disagreements(silver.forecast(spark, sf)).select("season", "fixture_id", "prediction", "pred_draw_030")


@query("d04_backfill_labels", f"SELECT season, fixture_id, model, predicted_at, {P} AS prediction, {RULE.format(t=0.30)} AS pred_draw_030 FROM fx_emitted")
def d04(spark, sf):
    from kickline.sources.versions import VersionedTable
    table = VersionedTable(spark, "registry_backfill", unique=True)
    table.write(silver.emissions(spark, sf), "emitted")
    table.write(dec.label_all(table.read()), "labelled")
    return table.read().select("season", "fixture_id", "model", "predicted_at", "prediction", "pred_draw_030")


@query("d05_latest_registered", "SELECT season, gameweek, max(predicted_at) AS predicted_at FROM fx_emitted GROUP BY ALL")
def d05(spark, sf):
    return reg.latest(silver.emissions(spark, sf), ["season", "gameweek"])


BETS_SQL = "bets AS (SELECT *, CASE WHEN bet = result THEN odds - 1 ELSE -1.0 END AS gain FROM (" + " UNION ALL ".join(
    f"SELECT season, gameweek, fixture_id, kick, result, '{c}' AS bet, {i} AS class_no, {{p}}_{c} AS p, odds_{c} AS odds, {{p}}_{c} * odds_{c} - 1 AS ev FROM fx_pred" for i, c in enumerate(CL)) + ") WHERE ev > 0.05)"
KEEP = ["season", "gameweek", "fixture_id", "kick", "result"]


@query("d06_value_bets", f"WITH {BETS_SQL.format(p='p')} SELECT season, gameweek, fixture_id, bet, round(p, 9) AS p, odds, round(ev, 9) AS ev, bet = result AS hit, round(gain, 9) AS gain FROM bets")
def d06(spark, sf):
    b = bet.candidates(silver.forecast(spark, sf), keep=KEEP)
    return rounded(b.select("season", "gameweek", "fixture_id", "bet", "p", "odds", "ev", "hit", "gain"), "p", "ev", "gain", digits=9)


def _sim_sql(src):
    return f"""c AS (SELECT *, sum(CAST(round(gain * 10) AS BIGINT)) OVER (PARTITION BY season ORDER BY kick, class_no ROWS UNBOUNDED PRECEDING) AS cum FROM {src}),
    dd AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY season ORDER BY kick, class_no ROWS UNBOUNDED PRECEDING)) - cum AS below FROM c)
    SELECT season, count(*) AS n_bets, round(sum(gain), 4) AS net, round(avg(gain), 6) AS roi, round(avg(CASE WHEN bet = result THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(odds), 6) AS mean_odds, round(max(below) / 10, 6) AS max_drawdown FROM dd GROUP BY season"""


def _sim(b):
    out = bet.simulate(b, ["season"], ["kick", "class_no"])
    return rounded(out, "roi", "hit_rate", "mean_odds", "max_drawdown").withColumn("net", F.round("net", 4))


@query("d07_bet_simulation", f"WITH {BETS_SQL.format(p='p')}, {_sim_sql('bets')}")
def d07(spark, sf):
    return _sim(bet.candidates(silver.forecast(spark, sf), keep=KEEP))


@query("d08_always_home_reference", f"WITH h AS (SELECT season, kick, 2 AS class_no, 'home' AS bet, result, odds_home AS odds, CASE WHEN result = 'home' THEN odds_home - 1 ELSE -1.0 END AS gain FROM fx_pred WHERE odds_home IS NOT NULL), {_sim_sql('h')}")
def d08(spark, sf):
    return _sim(bet.always_home(silver.forecast(spark, sf), KEEP))


@query("d09_bets_by_class", f"WITH {BETS_SQL.format(p='p')} SELECT bet, count(*) AS n, round(avg(CASE WHEN bet = result THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(odds), 6) AS mean_odds, round(avg(ev), 6) AS mean_ev, round(sum(gain), 4) AS net, round(avg(gain), 6) AS roi FROM bets GROUP BY bet")
def d09(spark, sf):
    b = bet.candidates(silver.forecast(spark, sf), keep=KEEP)
    return b.groupBy("bet").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
                                F.round(F.avg("odds"), 6).alias("mean_odds"), F.round(F.avg("ev"), 6).alias("mean_ev"),
                                F.round(F.sum("gain"), 4).alias("net"), F.round(F.avg("gain"), 6).alias("roi"))


@query("d10_cost_of_draw_bias", f"""WITH b AS (SELECT avg(CASE WHEN result = 'draw' THEN 1.0 ELSE 0.0 END) - avg(p_draw) AS missing FROM fx_pred),
    s0 AS (SELECT f.*, p_draw + missing AS d, p_away * (1 - (p_draw + missing)) / (p_away + p_home) AS a, p_home * (1 - (p_draw + missing)) / (p_away + p_home) AS h FROM fx_pred f, b),
    s AS (SELECT *, a / (a + d + h) AS c_away, d / (a + d + h) AS c_draw, h / (a + d + h) AS c_home FROM (SELECT * REPLACE (least(greatest(d, 1e-9), 1) AS d, least(greatest(a, 1e-9), 1) AS a, least(greatest(h, 1e-9), 1) AS h) FROM s0)),
    x AS (SELECT result, cls, ver, p * odds - 1 AS ev, CASE WHEN cls = result THEN odds - 1 ELSE -1.0 END AS gain FROM (""" + " UNION ALL ".join(
        f"SELECT result, '{c}' AS cls, '{v}' AS ver, {k}_{c} AS p, odds_{c} AS odds FROM s" for v, k in (("original", "p"), ("corrected", "c")) for c in CL) + f"""))
    SELECT ver AS version, n_bets, roi, CASE ver WHEN 'original' THEN (SELECT round(avg(-ln({PA})), 6) FROM s) ELSE (SELECT round(avg(-ln({PA.replace("p_", "c_")})), 6) FROM s) END AS log_loss
    FROM (SELECT ver, count(*) FILTER (WHERE ev > 0.05) AS n_bets, round(avg(gain) FILTER (WHERE ev > 0.05), 6) AS roi FROM x GROUP BY ver)""")
def d10(spark, sf):
    return mon.draw_bias_cost(silver.forecast(spark, sf))


@query("d11_weighted_ensemble", "SELECT season, fixture_id, " + ", ".join(
    f"round((0.7 * p_{c} + 0.3 * q_{c}) / (0.7 * (p_away + p_draw + p_home) + 0.3 * (q_away + q_draw + q_home)), 9) AS e_{c}" for c in CL) + " FROM fx_pred")
def d11(spark, sf):
    return rounded(mon.ensemble(silver.forecast(spark, sf), {"p": 0.7, "q": 0.3}).select("season", "fixture_id", "e_away", "e_draw", "e_home"), "e_away", "e_draw", "e_home", digits=9)
