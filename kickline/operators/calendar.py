"""Gameweeks: cut-offs, deadlines, status and what can be predicted next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.windows import DAY_US, running

DEADLINE_OFFSET_US = 90 * 60 * 1_000_000   # fixed value: 90 minutes
POSTPONED_GRACE_DAYS = 7                   # fixed value


def cutoff_per_gameweek(fixtures: DataFrame, time: str, keys: tuple[str, str] = ("season", "gameweek"),
                        out: str = "cutoff") -> DataFrame:
    """Start of each gameweek. Fixtures without a gameweek have no cut-off."""
    return (fixtures.filter(F.col(keys[1]).isNotNull()).groupBy(*keys).agg(F.min(time).alias(out)))


def slot_of(time: str, instants: list[int]) -> Column:
    """How many of the sorted instants are at or before the time, by binary search."""
    halves = [1 << i for i in range(len(instants).bit_length() - 1, -1, -1)]
    if not instants:
        return F.lit(0)
    grid = F.lit(instants).cast("array<bigint>")
    return F.aggregate(F.lit(halves), F.lit(0), lambda at, h: F.when(F.get(grid, at + h - 1) <= F.col(time), at + h).otherwise(at))


def last_before(df: DataFrame, keys: list[str], order: list[str], instants: list[int], cols: list[str] | None = None) -> DataFrame:
    """`keys, order, cols`: the last row of every key in every gap between the sorted instants.

    What a key shows strictly before one of the instants is among them. An aggregate, so a history shrinks before the shuffle.
    """
    dated = df.filter(F.col(order[0]).isNotNull())
    last = dated.groupBy(*keys, slot_of(order[0], instants).alias("_slot")).agg(F.max(F.struct(*order, *(cols or []))).alias("_last"))
    return last.select(*keys, "_last.*")


def deadlines(fixtures: DataFrame, time: str, published: DataFrame | None = None,
              keys: tuple[str, str] = ("season", "gameweek")) -> DataFrame:
    """Published deadline where there is one, else the first kick-off minus 90 minutes,
    with its provenance. `published`: keys and `published_at`."""
    derived = cutoff_per_gameweek(fixtures, time, keys).withColumn(
        "_derived", F.col("cutoff") - DEADLINE_OFFSET_US)
    if published is None:
        return derived.select(*keys, F.col("_derived").alias("deadline"), F.lit("derived").alias("deadline_source"))
    return (derived.join(published, list(keys), "left")
            .select(*keys, F.coalesce("published_at", "_derived").alias("deadline"),
                    F.when(F.col("published_at").isNotNull(), "api").otherwise("derived").alias("deadline_source")))


def gameweek_status(fixtures: DataFrame, played: Column, now_us: int, time: str = "kick",
                    split: bool = True) -> DataFrame:
    """One row per (season, gameweek): counts of the gameweek and of all earlier fixtures.

    A fixture still unplayed seven days after its cut-off counts as postponed and
    is no longer waited for. Fixtures before a cut-off are counted with running
    totals over the season's instants, so no fixture is paired with a gameweek.
    """
    cut = cutoff_per_gameweek(fixtures, time)
    fx = (fixtures.join(cut, ["season", "gameweek"], "left")
          .withColumn("_played", F.coalesce(played, F.lit(False)))
          .withColumn("_postponed", F.coalesce(~F.col("_played") & (
              F.col("cutoff") < now_us - POSTPONED_GRACE_DAYS * DAY_US), F.lit(False)))
          .withColumn("_waiting", ~F.col("_played") & ~F.col("_postponed")))
    per_gw = (fx.filter(F.col("gameweek").isNotNull()).groupBy("season", "gameweek", "cutoff")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("_played").alias("n_played"),
                   F.count_if("_waiting").alias("n_pending")))
    from kickline.operators.asof import History, asof_attach
    instants = (fx.filter(F.col(time).isNotNull()).groupBy("season", time)
                .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_played").alias("_p"),
                     F.count_if("_waiting").alias("_w")))
    cum = running(instants, ["season"], [time],
                  sums={"prev_n": "_n", "prev_played": "_p", "prev_pending": "_w"}, split=split)
    out = asof_attach(per_gw, ["season"], "cutoff",
                      [History(cum, time, ["prev_n", "prev_played", "prev_pending"])], split)
    prev = ["prev_n", "prev_played", "prev_pending"]
    return (out.withColumns({c: F.coalesce(c, F.lit(0)) for c in prev})
            .withColumn("final", F.col("prev_pending") == 0)
            .withColumn("situation", F.when(F.col("n_played") == F.col("n"), "complete")
                        .when(F.col("n_played") > 0, "in_progress").otherwise("pending")))


def next_predictable(status: DataFrame) -> DataFrame:
    """Smallest gameweek per season that still has something to predict and is final."""
    return (status.filter((F.col("n_pending") > 0) & F.col("final"))
            .groupBy("season").agg(F.min("gameweek").alias("next_gameweek")))


def season_index(fixtures: DataFrame, played: Column, first: int = 1) -> DataFrame:
    """Every gameweek number of every season up to the last of any season, present or not."""
    last = fixtures.agg(F.max("gameweek").alias("_last"))   # one row
    spine = (fixtures.select("season").distinct().crossJoin(F.broadcast(last))
             .select("season", F.explode(F.sequence(F.lit(first), F.col("_last").cast("int"))).alias("gameweek")))
    agg = (fixtures.groupBy("season", "gameweek")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(played).alias("n_played"), F.min("kick").alias("cutoff")))
    return (spine.join(agg, ["season", "gameweek"], "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_played")})
            .withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n_played") == F.col("n"), "complete")
                        .when(F.col("n_played") > 0, "in_progress").otherwise("pending")))
