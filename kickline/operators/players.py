"""From player rows to team and match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.operators.joins import opponent_value

POSITIONS = {"GK": "gk", "DEF": "def", "MID": "mid", "FWD": "fwd"}   # fixed values
GAME = ["season", "gameweek", "fixture_id", "team"]


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order. An aggregate, so repeats shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def duplicate_report(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_dropped")))


def by_fixture(players: DataFrame) -> DataFrame:
    """Sums, the count of players with minutes, the save rate and the points per line, in one pass."""
    p = players.filter(F.col("position").isin(*POSITIONS))
    line = {f"pts_{v}": F.coalesce(F.sum(F.when(F.col("position") == k, F.col("points"))), F.lit(0))
            for k, v in POSITIONS.items()}
    agg = p.groupBy(*GAME).agg(
        F.coalesce(F.sum("xg"), F.lit(0.0)).alias("xg"), F.coalesce(F.sum("xa"), F.lit(0.0)).alias("xa"),
        F.count_if(F.col("minutes") > 0).alias("n_players"),
        F.coalesce(F.sum("saves"), F.lit(0)).alias("saves"), F.max("conceded").alias("_conceded"),
        *[c.alias(n) for n, c in line.items()])
    return (agg.withColumn("save_rate", F.try_divide(F.col("saves"), F.col("saves") + F.col("_conceded")))
            .drop("_conceded"))


def mask_false_zeros(df: DataFrame, first_gameweek: dict[int, int], cols: list[str], flag: str = "xg_available") -> DataFrame:
    """Some seasons publish a statistic as zero before some gameweek: NULL there, with a flag."""
    unknown: Column = F.lit(False)
    for season, gw in first_gameweek.items():
        unknown = unknown | ((F.col("season") == season) & (F.col("gameweek") < gw))
    return df.withColumns({**{c: F.when(~unknown, F.col(c)) for c in cols}, flag: ~unknown})


def team_stats_by_fixture(players: DataFrame, first_gameweek: dict[int, int] | None = None, stats: list[str] | None = None) -> DataFrame:
    """Team and match grain, all statistics or `stats` and the expected goals. Expected goals against are the rival's expected goals, so a fixture
    with a single side yields nothing."""
    own = by_fixture(players)
    own = own if stats is None else own.select(*GAME, *dict.fromkeys(["xg", *stats]))
    both = opponent_value(own, ["season", "fixture_id"], "team", {"xgc": "xg"})
    return mask_false_zeros(both.filter(F.col("xgc").isNotNull()), first_gameweek or {}, [c for c in ("xg", "xa", "xgc") if c in both.columns])
