"""Monitoring of forecasts and rules, every gameweek in one grouped job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.functions.market import implied, overround, shift_draw
from kickline.operators import betting as bet
from kickline.operators import compare as cmp
from kickline.operators import decision as dec
from kickline.operators import scoring as sc
from kickline.operators.quantiles import exact_percentiles

CL = sc.CLASSES


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def per_gameweek(forecasts: DataFrame, rules: tuple[dec.Rule, ...] = dec.RULES) -> DataFrame:
    """Each rule of each gameweek against the results and the always-home baseline."""
    p = sc.probs("p")
    long = dec.by_rule(forecasts, rules)
    return long.groupBy("season", "gameweek", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.round(_share(F.col("label") == F.col("result")), 6).alias("accuracy"),
        F.count_if(F.col("label") == "draw").alias("draws"),
        F.round(_share(F.col("result") == "home"), 6).alias("acc_home"),
        F.round(F.avg(F.greatest(*p)), 6).alias("mean_confidence"),
        F.round(F.avg(sc.log_loss_term(sc.prob_of(F.col("result"), *p))), 6).alias("log_loss"),
        F.round(F.avg(sc.rps_term(F.col("result"), *p)), 6).alias("rps"),
        F.bool_and("prospective").alias("prospective"))


def _per_rule(forecasts: DataFrame, rules: tuple[dec.Rule, ...]) -> DataFrame:
    p = sc.probs("p")
    return dec.by_rule(forecasts, rules).groupBy("season", "gameweek", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("result")).alias("hits"),
        F.count_if(F.col("result") == "home").alias("home"), F.count_if(F.col("label") == "draw").alias("draws"),
        F.avg(sc.log_loss_term(sc.prob_of(F.col("result"), *p))).alias("ll"))


def summary(forecasts: DataFrame, rules: tuple[dec.Rule, ...] = dec.RULES) -> DataFrame:
    """Accumulated over gameweeks, with the share of gameweeks won against always-home."""
    g = _per_rule(forecasts, rules)
    return g.groupBy("season", "rule").agg(
        F.count(F.lit(1)).alias("gameweeks"), F.sum("n").alias("matches"),
        F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("ll"), 6).alias("mean_log_loss"),
        F.round(_share(F.col("hits") > F.col("home")), 6).alias("share_won"))


def rules_overall(forecasts: DataFrame, rules: tuple[dec.Rule, ...] = dec.RULES) -> DataFrame:
    g = _per_rule(forecasts, rules)
    return g.groupBy("rule").agg(
        F.count(F.lit(1)).alias("gameweeks"), F.sum("n").alias("matches"),
        F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"),
        F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("mean_per_gameweek"), F.sum("draws").alias("draws"))


def compare_rule(forecasts: DataFrame, candidate: dec.Rule, production: dec.Rule = dec.PRODUCTION) -> DataFrame:
    """Candidate against production on the same forecasts, prospective gameweeks apart from the
    ones the rule was chosen on."""
    p = sc.probs("p")
    hits = forecasts.select(candidate.prospective().alias("prospective"),
                            (candidate.label(*p) == F.col("result")).alias("a"),
                            (production.label(*p) == F.col("result")).alias("b"))
    return cmp.mcnemar(hits, ["prospective"], "a", "b")


def quantile_table(df: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """Right-closed quantile bins with linearly interpolated edges; equal edges merge."""
    names = [f"e{i:02d}" for i in range(1, bins)]
    edges = exact_percentiles(df, [], score, {n: (i + 1) / bins for i, n in enumerate(names)})
    edges = edges.select(F.array_distinct(F.array(*names)).alias("_edges"))
    return (df.filter(F.col(score).isNotNull()).crossJoin(F.broadcast(edges))   # one row
            .withColumn("decile", F.size(F.filter("_edges", lambda e: F.col(score) > e)))
            .groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("p_mean"),
                                   _share(positive).alias("observed")))


def class_prior_baseline(train: DataFrame, test: DataFrame, group: list[str], actual: str) -> DataFrame:
    prior = train.agg(*[_share(F.col(actual) == c).alias(f"_prior_{c}") for c in CL])
    p = sc.probs("_prior")
    return (test.crossJoin(F.broadcast(prior)).groupBy(*group)   # one row
            .agg(F.count(F.lit(1)).alias("n"), F.avg(sc.log_loss_term(sc.prob_of(F.col(actual), *p))).alias("log_loss"),
                 _share(sc.argmax_class(*p) == F.col(actual)).alias("accuracy")))


def market_baseline(df: DataFrame, group: list[str], actual: str, rollup: bool = False) -> DataFrame:
    odds = [F.col(f"odds_{c}") for c in ("home", "draw", "away")]
    m = implied(*odds)
    d = df.filter(F.col("odds_home").isNotNull() & F.col(actual).isNotNull()).select(
        *group, F.col(actual).alias("_y"), overround(*odds).alias("_over"), *[v.alias(f"_m_{k}") for k, v in m.items()])
    p = sc.probs("_m")
    grouped = d.rollup(*group) if rollup else d.groupBy(*group)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), _share(F.col("_y") == "draw").alias("draw_rate"),
        _share(F.col("_y") == "home").alias("acc_home"), _share(sc.market_argmax(*p) == F.col("_y")).alias("accuracy"),
        F.avg(sc.log_loss_term(sc.prob_of(F.col("_y"), *p))).alias("log_loss"), F.avg("_over").alias("mean_overround"))


def threshold_sweep(forecasts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Every threshold in one pass: rows are first counted per (threshold, label, result)."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    x = forecasts.select("result", "p_away", "p_draw", "p_home", grid)
    said = dec.draw_threshold(F.col("threshold"), *sc.probs("p"))
    c = x.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said == "draw").alias("draws"),
        F.count_if((said == "draw") & (F.col("result") == "draw")).alias("tp"),
        F.count_if(F.col("result") == "draw").alias("pos"), F.count_if(said == F.col("result")).alias("hits"))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return c.select("threshold", "draws", "tp", ratio(F.col("tp"), F.col("draws")).alias("precision"),
                    ratio(F.col("tp"), F.col("pos")).alias("recall"),
                    ratio(2 * F.col("tp"), F.col("draws") + F.col("pos")).alias("f1"),
                    F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"))


def versions_over_seeds(df: DataFrame, groups: dict[str, Column], seed: str = "seed") -> DataFrame:
    """Two versions on the same matches for several seeds: a paired test per seed, then mean and
    sample deviation over seeds, per subgroup."""
    from kickline.plans.training_rows import by_subgroup
    per_seed = cmp.mcnemar(by_subgroup(df, groups), ["subgroup", seed], "a", "b")
    return per_seed.groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("acc_a").alias("mean_a"), F.stddev_samp("acc_a").alias("sd_a"),
        F.avg("acc_b").alias("mean_b"), F.stddev_samp("acc_b").alias("sd_b"), F.min("p_value").alias("min_p"))


def draw_bias_cost(forecasts: DataFrame, edge: float = bet.DEFAULT_EDGE) -> DataFrame:
    """Bets, return and log-loss as forecast and after giving the draw its missing share back."""
    missing = forecasts.agg((_share(F.col("result") == "draw") - F.avg("p_draw")).alias("_missing"))
    f = forecasts.crossJoin(F.broadcast(missing))   # one row
    shifted = shift_draw(F.col("p_away"), F.col("p_draw"), F.col("p_home"), F.col("_missing"))
    both = f.select("result", *[f"odds_{c}" for c in CL], F.explode(F.array(
        F.struct(F.lit("original").alias("version"), *[F.col(f"p_{c}").alias(f"x_{c}") for c in CL]),
        F.struct(F.lit("corrected").alias("version"), *[shifted[c].alias(f"x_{c}") for c in CL]))).alias("v")
    ).select("result", *[f"odds_{c}" for c in CL], "v.*")
    loss = both.groupBy("version").agg(
        F.round(F.avg(sc.log_loss_term(sc.prob_of(F.col("result"), *sc.probs("x")))), 6).alias("log_loss"))
    bets = bet.candidates(both, edge, keep=["version", "result"], p="x")
    won = bets.groupBy("version").agg(F.count(F.lit(1)).alias("n_bets"), F.round(F.avg("gain"), 6).alias("roi"))
    return loss.join(won, "version", "left")


def ensemble(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of several probability triples, renormalised. `weights`: column prefix -> weight."""
    mixed = {c: sum((F.lit(w) * F.col(f"{k}_{c}") for k, w in weights.items()), F.lit(0.0)) for c in CL}
    total = sum(mixed.values(), F.lit(0.0))
    return df.select("*", *[(v / total).alias(f"e_{c}") for c, v in mixed.items()])
