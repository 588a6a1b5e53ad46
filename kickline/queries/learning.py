"""Training, evaluation and scoring on the assembled table (L-*)."""

from pyspark.sql import functions as F

from kickline.functions import goals
from kickline.functions.market import temper
from kickline.operators import decision as dec
from kickline.operators import likelihood as lk
from kickline.operators import scoring as sc
from kickline.operators.joins import sized_broadcast
from kickline.operators.topk import best_point
from kickline.plans import contract as ct
from kickline.plans import learning as ln
from kickline.plans import training_rows as tr
from kickline.queries.base import query
from kickline.queries.columns import _LAM, _MU, rate_cols
from kickline.queries.gold import CURRENT, HOLDOUT, TRAIN, built_gold
from kickline.queries.joins import played_until
from kickline.queries.scores import PA
from kickline.queries.windows import rounded
from kickline.session import stage
from kickline.sources import silver

FEATS = [f"dif_{d}" for d in ct.DIFFERENTIALS]
VALID = 1999
_frames: dict = {}


def data(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _frames:
        _frames[key] = stage(ln.frame(built_gold(spark, sf), FEATS), "training")   # every fit reads it
    return _frames[key].filter(F.col("label").isNotNull())


def train_test(spark, sf, test=HOLDOUT):
    d = data(spark, sf)
    return d.filter(F.col("season").isin(TRAIN)), d.filter(F.col("season") == test)


def graded(scored):
    return rounded(ln.quality(scored), "accuracy", "log_loss", "rps")


@query("l01_temporal_split", "SELECT CASE WHEN season = 2000 THEN 'holdout' WHEN season = 1999 THEN 'valid' ELSE 'train' END AS part, count(*) AS n FROM fx_match WHERE season BETWEEN 1995 AND 2000 GROUP BY 1")
def l01(spark, sf):
    return tr.temporal_split(silver.match(spark, sf), TRAIN, VALID, HOLDOUT).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("l02_refit_rows", "SELECT season, count(*) AS n FROM fx_match WHERE season BETWEEN 1995 AND 2000 GROUP BY season")
def l02(spark, sf):
    return tr.refit_rows(silver.match(spark, sf), TRAIN, HOLDOUT, include_holdout=True).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("l03_multinomial_logistic")
def l03(spark, sf):
    return graded(ln.logistic(*train_test(spark, sf), FEATS))


@query("l04_random_forest")
def l04(spark, sf):
    return graded(ln.forest(*train_test(spark, sf), FEATS))


@query("l05_boosted_trees")
def l05(spark, sf):
    return graded(ln.boosted(*train_test(spark, sf), FEATS, rounds=5))


@query("l06_poisson_goals")
def l06(spark, sf):
    return graded(ln.poisson_goals(*train_test(spark, sf), FEATS))


@query("l07_rho_by_likelihood", f"""WITH r AS (SELECT {_LAM} AS lam, {_MU} AS mu, home_goals AS x, away_goals AS y FROM fx_match),
    b AS (SELECT greatest(-1 / max(lam), -1 / max(mu), -0.4) AS lo, least(1 / max(lam * mu), 1.0, 0.4) AS hi FROM r),
    g AS (SELECT CAST(step AS INT) AS step, lo + (hi - lo) * step / 80 AS rho FROM b, range(81) t(step)),
    l AS (SELECT step, rho, sum(ln(greatest(CASE WHEN x = 0 AND y = 0 THEN 1 - lam * mu * rho WHEN x = 0 AND y = 1 THEN 1 + lam * rho WHEN x = 1 AND y = 0 THEN 1 + mu * rho ELSE 1 - rho END, 1e-12))) AS ll FROM r, g WHERE x <= 1 AND y <= 1 GROUP BY ALL)
    SELECT step, round(rho, 6) AS rho, round(ll, 4) AS log_lik FROM l""")
def l07(spark, sf):
    lam, mu = rate_cols()
    m = silver.match(spark, sf).select(lam.alias("lam"), mu.alias("mu"), "home_goals", "away_goals")
    out = goals.rho_likelihood(m, "lam", "mu", "home_goals", "away_goals")
    return out.select("step", F.round("rho", 6).alias("rho"), F.round("log_lik", 4).alias("log_lik"))


def _newton(start: str, step: str, names: str = "x", steps: int = 12) -> str:
    """A chain of Newton steps as common table expressions n0 ... n<steps>; `step` reads {prev}."""
    chain = [f"n0 AS MATERIALIZED (SELECT {start} AS x)"] + [f"n{i} AS MATERIALIZED ({step.format(prev=f'n{i - 1}')})" for i in range(1, steps + 1)]
    return ", ".join(chain)


_RHO_SQL = f"""WITH r AS (SELECT season, result, {_LAM} AS lam, {_MU} AS mu, home_goals AS x, away_goals AS y FROM fx_match),
    e AS (SELECT greatest(-1 / max(lam), -1 / max(mu), -0.4) AS lo, least(1 / max(lam * mu), 1.0, 0.4) AS hi FROM r WHERE season < 2000),
    c AS MATERIALIZED (SELECT CASE WHEN x + y = 0 THEN -lam * mu WHEN x = 0 THEN lam WHEN y = 0 THEN mu ELSE -1 END AS c FROM r WHERE x <= 1 AND y <= 1 AND season < 2000),
    {_newton("0.0::DOUBLE", "SELECT least(max(hi), greatest(max(lo), max(x) + sum(c / (1 + c * x)) / sum(pow(c / (1 + c * x), 2)))) AS x FROM c, {prev}, e")},
    k AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS k), g AS (SELECT r.season, r.result, lam, mu, n12.x AS rho, a.k AS x, b.k AS y, exp(-lam) * pow(lam, a.k) / factorial(a.k) * exp(-mu) * pow(mu, b.k) / factorial(b.k) AS p, row_number() OVER () AS i FROM r, n12, k a, k b WHERE season = 2000),
    t AS (SELECT g.*, greatest(p * CASE WHEN x = 0 AND y = 0 THEN 1 - lam * mu * rho WHEN x = 0 AND y = 1 THEN 1 + lam * rho WHEN x = 1 AND y = 0 THEN 1 + mu * rho WHEN x = 1 AND y = 1 THEN 1 - rho ELSE 1 END, 0) AS q FROM g)"""


@query("l07_rho_fitted", f"""{_RHO_SQL.replace("r.season, r.result,", "r.season, r.fixture_id, r.result,").replace("SELECT season, result, exp", "SELECT season, fixture_id, result, exp").replace(", row_number() OVER () AS i", "")},
    m AS (SELECT fixture_id, any_value(rho) AS rho, sum(p) FILTER (WHERE x = y) / sum(p) AS was, sum(q) FILTER (WHERE x = y) / sum(q) AS now, any_value(result) AS result FROM t GROUP BY fixture_id)
    SELECT round(any_value(rho), 4) AS rho, count(*) AS n, round(avg(was), 5) AS p_draw_before, round(avg(now), 5) AS p_draw_after, round(avg(CASE WHEN result = 'draw' THEN 1.0 ELSE 0 END), 6) AS drawn FROM m""")
def l07b(spark, sf):
    """rho by maximum likelihood on the training seasons, used on the holdout."""
    lam, mu = rate_cols()
    m = silver.match(spark, sf).select("season", "result", "home_goals", "away_goals", lam.alias("lam"), mu.alias("mu"))
    rho = lk.fit_rho(m.filter(F.col("season").isin(TRAIN)), "lam", "mu", "home_goals", "away_goals")
    held = goals.with_outcome_probs(goals.with_outcome_probs(m.filter(F.col("season") == HOLDOUT), "lam", "mu", 0.0, "was"), "lam", "mu", rho)
    return held.agg(F.round(F.lit(rho), 4).alias("rho"), F.count(F.lit(1)).alias("n"), F.round(F.avg("was_draw"), 5).alias("p_draw_before"),
                    F.round(F.avg("p_draw"), 5).alias("p_draw_after"), F.round(F.avg((F.col("result") == "draw").cast("double")), 6).alias("drawn"))


@query("l08_exact_score_classifier")
def l08(spark, sf):
    return graded(ln.exact_score(*train_test(spark, sf), FEATS))


@query("l09_ordinal_logit")
def l09(spark, sf):
    return graded(ln.ordinal(*train_test(spark, sf), FEATS))


@query("l10_small_network")
def l10(spark, sf):
    return graded(ln.neural(*train_test(spark, sf), FEATS, max_iter=20))


@query("l11_seed_averaging")
def l11(spark, sf):
    return graded(ln.seed_average(ln.forest, *train_test(spark, sf), FEATS, seeds=[42, 43, 44], trees=10))


@query("l12_round_choice_then_refit")
def l12(spark, sf):
    d = data(spark, sf)
    inner = d.filter(F.col("season").isin([s for s in TRAIN if s != VALID]))
    rounds, losses = ln.best_rounds(inner, d.filter(F.col("season") == VALID), FEATS, [2, 4])
    return graded(ln.boosted(*train_test(spark, sf), FEATS, rounds=rounds)).withColumn("rounds", F.lit(rounds))


_wide: dict = {}


def wide(spark, sf):
    """The training rows with every feature of the contract."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _wide:
        _wide[key] = stage(ln.frame(built_gold(spark, sf), list(ct.FEATURES)), "training-wide")
    return _wide[key].filter(F.col("label").isNotNull())


@query("l12_early_stopping")
def l12b(spark, sf):
    """All features; rounds by early stopping on the validation season, refit with it, graded on the holdout."""
    d = wide(spark, sf)
    inner, valid, test = d.filter(F.col("season").isin([s for s in TRAIN if s != VALID])), d.filter(F.col("season") == VALID), d.filter(F.col("season") == HOLDOUT)
    scored, rounds, losses = ln.boosted_early(inner, valid, test, list(ct.FEATURES))
    return graded(scored).withColumns({"rounds": F.lit(rounds), "n_features": F.lit(len(ct.FEATURES)), "validation_loss": F.round(F.lit(losses[rounds - 1]), 6)})


@query("l13_walk_forward")
def l13(spark, sf):
    scored = ln.walk_forward(data(spark, sf), FEATS, CURRENT, ln.forest, trees=5, depth=4)
    return rounded(ln.quality(stage(scored, "walk-forward"), ["season", "gameweek"]), "accuracy", "log_loss", "rps")


@query("l14_expanding_folds", """WITH f AS (SELECT cutoff, CAST(ntile(6) OVER (ORDER BY cutoff) - 1 AS INT) AS fold FROM (SELECT DISTINCT cutoff FROM fx_cut)) SELECT fold, count(*) AS n, count(DISTINCT c.cutoff) AS gameweeks FROM fx_match JOIN fx_cut c USING (season, gameweek) JOIN f ON f.cutoff = c.cutoff GROUP BY fold""")
def l14(spark, sf):
    m = silver.match(spark, sf).join(silver.cutoffs(spark, sf), ["season", "gameweek"])
    folds = ln.temporal_folds(silver.cutoffs(spark, sf), 5)
    return (m.join(sized_broadcast(folds), "cutoff").groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cutoff").alias("gameweeks")))


@query("l15_random_search")
def l15(spark, sf):
    d = data(spark, sf).filter(F.col("season").isin(TRAIN))
    folds = ln.temporal_folds(d, 2)
    points = [{"reg": 0.01, "max_iter": 20}, {"reg": 0.1, "max_iter": 20}]   # current configuration first
    return rounded(ln.random_search(d, FEATS, folds, 2, points), "mean_log_loss", "sd_log_loss")


@query("l16_model_by_data_variant")
def l16(spark, sf):
    train, test = train_test(spark, sf)
    variants = {"all": F.lit(True), "from_gw6": F.col("gameweek") >= 6}
    out = None
    for name, cond in variants.items():
        rows = train.filter(cond)
        with ln.assembled(rows, FEATS, True) as prepared:   # both models scale
            for model in ("logistic", "ordinal"):
                one = graded(ln.LEARNERS[model](rows, test, FEATS, prepared=prepared)).select(F.lit(model).alias("model"), F.lit(name).alias("variant"), "*")
                out = one if out is None else out.unionByName(one)
    return out


@query("l17_block_ablation")
def l17(spark, sf):
    train, test = train_test(spark, sf)
    blocks = {"none": [], "ratings": ["dif_elo", "dif_elo_delta_u5", "dif_surprise_u10"], "competitions": ["dif_games_all_14d", "dif_cup_games", "dif_round_max", "dif_pts_all_u5"]}
    out = None
    for name, gone in blocks.items():
        one = graded(ln.logistic(train, test, [f for f in FEATS if f not in gone], max_iter=20)).select(F.lit(name).alias("without"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_T = "pow(p_{c}, 1 / temperature) / (pow(p_away, 1 / temperature) + pow(p_draw, 1 / temperature) + pow(p_home, 1 / temperature))"


@query("l18_temperature_on_validation", f"""WITH g AS (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0, 3.0]::DOUBLE[]) AS temperature) SELECT temperature, round(avg(-ln(CASE result WHEN 'away' THEN {_T.format(c='away')} WHEN 'draw' THEN {_T.format(c='draw')} ELSE {_T.format(c='home')} END)), 6) AS log_loss FROM fx_pred, g WHERE season = 1999 GROUP BY temperature""")
def l18(spark, sf):
    f = silver.forecast(spark, sf).filter(F.col("season") == VALID)   # fitted on the validation season only
    return rounded(ln.temperature_grid(f, [0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0, 3.0]), "log_loss")


_SAID = "CASE result WHEN 'away' THEN {0}away WHEN 'draw' THEN {0}draw ELSE {0}home END"
_WARM = "(CASE result WHEN 'away' THEN pow(p_away, 1 / t) WHEN 'draw' THEN pow(p_draw, 1 / t) ELSE pow(p_home, 1 / t) END) / (pow(p_away, 1 / t) + pow(p_draw, 1 / t) + pow(p_home, 1 / t))"


@query("l18_temperature_fitted", f"""WITH l AS MATERIALIZED (SELECT ln(p_away) AS a, ln(p_draw) AS d, ln(p_home) AS h, ln({_SAID.format("p_")}) AS y FROM fx_pred WHERE season = 1999),
    {_newton("1.0::DOUBLE", "SELECT least(1 / 0.3, greatest(1 / 5.0, max(b) + avg(y - m1) / avg(m2 - m1 * m1))) AS x FROM (SELECT y, x AS b, (a * exp(a * x) + d * exp(d * x) + h * exp(h * x)) / (exp(a * x) + exp(d * x) + exp(h * x)) AS m1, (a * a * exp(a * x) + d * d * exp(d * x) + h * h * exp(h * x)) / (exp(a * x) + exp(d * x) + exp(h * x)) AS m2 FROM l, {prev})")}
    SELECT round(max(t), 4) AS temperature, count(*) AS n, round(avg(-ln({_SAID.format("p_")})), 6) AS log_loss_before, round(avg(-ln({_WARM})), 6) AS log_loss_after FROM (SELECT f.*, 1 / x AS t FROM fx_pred f, n12 WHERE season = 2000)""")
def l18c(spark, sf):
    """The temperature of the validation season, used on the holdout."""
    f = silver.forecast(spark, sf)
    t = lk.fit_temperature(f.filter(F.col("season") == VALID), lk.class_columns(), "result")
    p, raw = temper({c: F.col(f"p_{c}") for c in sc.CLASSES}, t), sc.probs("p")
    warm = sc.prob_of(F.col("result"), *[p[c] for c in sc.CLASSES])
    return f.filter(F.col("season") == HOLDOUT).agg(F.round(F.lit(t), 4).alias("temperature"), F.count(F.lit(1)).alias("n"),
                                                    F.round(F.avg(sc.log_loss_term(sc.prob_of(F.col("result"), *raw))), 6).alias("log_loss_before"),
                                                    F.round(F.avg(sc.log_loss_term(warm)), 6).alias("log_loss_after"))


@query("l18_class_weights")
def l18b(spark, sf):
    train, test = train_test(spark, sf)
    return graded(ln.logistic(ln.balanced_weights(train), test, FEATS, weight="weight"))


@query("l19_feature_importance")
def l19(spark, sf):
    return rounded(ln.importance(train_test(spark, sf)[0], FEATS).orderBy(F.desc("importance"), "feature").limit(10), "importance")   # top-n report


@query("l20_enlargement", "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATS) + "]) AS feature, true AS size_near, true AS mean_near, true AS deviation_near")
def l20(spark, sf):
    """Size, mean and deviation of every enlarged column against those of the column itself."""
    train = train_test(spark, sf)[0]
    size = [F.count(F.lit(1)).alias("n")]
    moments = [x for f in FEATS for x in (F.mean(f).alias(f"m_{f}"), F.stddev(f).alias(f"s_{f}"))]
    was, now = train.agg(*size, *moments), ln.enlarge(train, 3, FEATS).agg(*size, *moments)   # one row each
    both = was.select(F.struct("*").alias("a")).crossJoin(now.select(F.struct("*").alias("b")))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), (F.abs(F.col("b.n") / F.col("a.n") - 3) < 0.3).alias("size_near"),
                              F.coalesce(F.abs(F.col(f"a.m_{f}") - F.col(f"b.m_{f}")) <= 0.2 * F.col(f"a.s_{f}"), F.lit(True)).alias("mean_near"),
                              F.coalesce(F.abs(F.col(f"b.s_{f}") - F.col(f"a.s_{f}")) <= 0.15 * F.col(f"a.s_{f}"), F.lit(True)).alias("deviation_near")) for f in FEATS])
    return both.select(F.explode(rows).alias("x")).select("x.*")


@query("l21_seed_stability")
def l21(spark, sf):
    out = ln.seed_stability(*train_test(spark, sf), FEATS, [42, 7], dec.CANDIDATES[0])
    return rounded(out, "acc_a", "acc_b", "p_value")


@query("l22_score_next_gameweek")
def l22(spark, sf):
    model = ln.fit_forest(train_test(spark, sf)[0], FEATS, trees=10)
    out = ln.score_gameweek(model, built_gold(spark, sf), FEATS, "forest-1", played_until())
    return rounded(out, *ln.PROBS)
