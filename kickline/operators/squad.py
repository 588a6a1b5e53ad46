"""Metrics over the last line-ups of a team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickline.operators.windows import lookback


def squad_windows(players: DataFrame, ordered: DataFrame, games: int = 5, split: bool = True) -> DataFrame:
    """Concentration of minutes (sum of squared shares) over the last `games` matches, and the
    share of those minutes played by the latest line-up.

    `ordered` has season, fixture_id, team and the ordinal `k`, numbered without gaps. Appearances are first summed
    per player and match; a match then carries its line-up as one array, and a window over the team's
    matches brings the last line-ups together, so no appearance is copied through an exchange.
    """
    key = ["season", "fixture_id", "team"]
    lineups = (players.filter(F.col("minutes") > 0).groupBy(*key, "player").agg(F.sum("minutes").alias("minutes"))
               .groupBy(*key).agg(F.collect_list(F.struct("player", "minutes")).alias("_lineup")))   # one squad
    zero = F.lit(0).cast(lineups.schema["_lineup"].dataType.elementType["minutes"].dataType)
    seen = lookback(ordered.join(lineups, key, "left"), ["team"], ["k"], games - 1,
                    lambda w: {"_last": F.collect_list("_lineup").over(w.rowsBetween(-(games - 1), 0))}, split)
    names = F.array_distinct(F.transform(F.flatten("_last"), lambda x: x["player"]))

    def of_player(p):
        own = F.filter(F.flatten("_last"), lambda x: x["player"].eqNullSafe(p))
        return F.struct(F.aggregate(own, zero, lambda a, x: a + x["minutes"]).alias("m"), F.exists("_lineup", lambda x: x["player"].eqNullSafe(p)).alias("latest"))

    def added(what, per_player="_p"):
        return F.aggregate(per_player, zero, lambda a, x: a + what(x))

    rows = seen.withColumn("_p", F.transform(names, of_player))
    some, total = F.size("_p") > 0, added(lambda x: x["m"])
    latest = F.when(F.col("_lineup").isNotNull(), added(lambda x: x["m"], F.filter("_p", lambda x: x["latest"])))
    return rows.select(*ordered.columns, F.when(some, added(lambda x: x["m"] * x["m"]) / (total * total)).alias("minutes_hhi"),
                       F.when(some, latest / total).alias("squad_continuity"))
