"""Which rows are training targets, and the matrix they become."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY_CAP = 38   # fixed value: one full season of matches


class SplitError(ValueError):
    pass


def split_label(target: str, season: str, holdout: int, train: list[int]) -> Column:
    """A missing target wins over everything else."""
    return (F.when(F.col(target).isNull(), "inference").when(F.col(season) == holdout, "holdout")
            .when(F.col(season).isin(train), "train").otherwise("current"))


def season_start(df: DataFrame, totals: list[str], undefined: list[str], played: str, n_hist: str | None = None) -> DataFrame:
    """Before a team's first game of the season its totals are zero and its ratios and rank undefined."""
    out = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in totals})
    out = out.withColumns({c: F.when(F.col(played) > 0, F.col(c)) for c in undefined})
    return out.withColumn(n_hist, F.coalesce(n_hist, F.lit(0))) if n_hist else out


def row_variants(first_gameweek: int, last_gameweek: int) -> dict[str, Column]:
    """Named predicates over candidate training rows."""
    return {"all": F.lit(True), "from_gw6": F.col("gameweek") >= first_gameweek,
            "with_odds": F.col("odds_home").isNotNull(), "no_last_gw": F.col("gameweek") < last_gameweek}


def with_target(df: DataFrame, target: str = "target") -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def count_variants(df: DataFrame, variants: dict[str, Column]) -> DataFrame:
    agg = with_target(df).agg(*[F.count_if(c).alias(n) for n, c in variants.items()])
    return (agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("n")) for n in variants])).alias("x"))
            .select("x.*"))


def by_subgroup(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row per subgroup a row belongs to, generated in one pass."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    return df.select("*", F.explode(tags).alias("subgroup"))


def feature_matrix(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Vector column in contract order; a missing column is an error, a missing value stays missing."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"feature columns absent: {missing}")
    cast = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in features])
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(cast).select(*keep, "features")


def temporal_split(df: DataFrame, train: list[int], valid: int, holdout: int, season: str = "season") -> DataFrame:
    """Rows tagged train, valid or holdout. The validation season is never the holdout."""
    if valid == holdout or holdout in train:
        raise SplitError("the holdout must not be used for fitting or validation")
    part = (F.when(F.col(season) == holdout, "holdout").when(F.col(season) == valid, "valid")
            .when(F.col(season).isin([s for s in train if s != valid]), "train"))
    return df.withColumn("part", part).filter(F.col("part").isNotNull())


def refit_rows(df: DataFrame, train: list[int], holdout: int, include_holdout: bool, season: str = "season") -> DataFrame:
    return df.filter(F.col(season).isin([*train, *([holdout] if include_holdout else [])]))
