"""Entities that were not there last season, and the prior that stands in for their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_GAMES = 5                              # fixed value
FILLED_WINDOWS = ("_cond_u5", "_u3", "_u5")  # fixed values: windows that cross seasons


def first_season(dim: DataFrame, key: str, ingest_from: int) -> DataFrame:
    """Adds whether the row is the entity's first season inside the window."""
    first = dim.groupBy(key).agg(F.min("season").alias("first_season"))
    return (dim.join(first, key)
            .withColumn("promoted", (F.col("season") == F.col("first_season")) & (F.col("season") != ingest_from)))


def promoted_flags(dim: DataFrame, key: str) -> DataFrame:
    """True when absent in the season listed before, NULL in the first one."""
    present = dim.select("season", key).distinct()
    seasons = present.select("season").distinct()
    listed = seasons.select("season", F.lag("season").over(Window.orderBy("season")).alias("_prev"))   # one row per season
    before = present.select(F.col("season").alias("_prev"), key, F.lit(True).alias("_was"))
    return (present.join(listed, "season").join(before, ["_prev", key], "left")
            .select("season", key, F.when(F.col("_prev").isNotNull(), F.col("_was").isNull()).alias("promoted")))


def first_games(long: DataFrame, keys: list[str], order: list[str], n: int = FIRST_GAMES) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def promoted_prior(long: DataFrame, flags: DataFrame, stats: list[str], seasons: list[int]) -> DataFrame:
    """One row: mean of each statistic over the first games of promoted entities, training seasons only."""
    rows = (long.filter(F.col("season").isin(seasons))
            .join(flags.filter("promoted").select("season", "team"), ["season", "team"], "left_semi"))
    first = first_games(rows, ["season", "team"], ["kick", "fixture_id"])
    return first.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(s).alias(s) for s in stats])


def base_stat(col: str, prefix: str) -> str | None:
    """The statistic behind a fillable window column, None for the others."""
    rest = col.removeprefix(f"{prefix}_")
    if rest == col or rest.endswith("_u5_season"):
        return None
    for suffix in FILLED_WINDOWS:
        if rest.endswith(suffix):
            return rest.removesuffix(suffix)
    return None


def apply_prior(wide: DataFrame, prior: DataFrame, prefixes: tuple[str, str] = ("home", "away")) -> DataFrame:
    """Fills the cross-season windows of promoted sides without history, nothing else."""
    named = prior.selectExpr(*[f"`{c}` AS `_prior_{c}`" for c in prior.columns])
    have, out = set(prior.columns), []
    for c in wide.columns:
        filled = next((f"coalesce(`{c}`, if(coalesce(`{p}_n_hist`, 0) = 0 AND `{p}_promoted`, `_prior_{stat}`, NULL)) AS `{c}`"
                       for p in prefixes if (stat := base_stat(c, p)) in have), f"`{c}`")
        out.append(filled)
    return wide.crossJoin(F.broadcast(named)).selectExpr(*out)   # the prior is one row
