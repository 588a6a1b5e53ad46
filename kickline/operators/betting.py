"""Value bets with a flat stake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.blocks import BLOCK, HOT, add_carry, hot_spans, with_block

CLASSES = ("away", "draw", "home")   # fixed order of the classes
DEFAULT_EDGE = 0.05                  # fixed value


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def candidates(df: DataFrame, edge: float = DEFAULT_EDGE, keep: list[str] | None = None, p: str = "p",
               actual: str = "result") -> DataFrame:
    """One row per (match, class) whose expected value exceeds `edge`, with its gain."""
    keep = keep or ["season", "gameweek", "fixture_id", actual]
    bets = df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(i).alias("class_no"), F.lit(c).alias("bet"), F.col(f"{p}_{c}").alias("p"),
                 F.col(f"odds_{c}").alias("odds"),
                 expected_value(F.col(f"{p}_{c}"), F.col(f"odds_{c}")).alias("ev"))
        for i, c in enumerate(CLASSES)])).alias("b")).select(*keep, "b.*")
    return settle(bets.filter(F.col("ev") > edge), actual)


def settle(bets: DataFrame, actual: str = "result") -> DataFrame:
    return (bets.withColumn("hit", F.col("bet") == F.col(actual))
            .withColumn("gain", F.when(F.col("hit"), F.col("odds") - 1).otherwise(-1.0)))


def always_home(df: DataFrame, keep: list[str], actual: str = "result") -> DataFrame:
    return settle(df.select(*keep, F.lit(2).alias("class_no"), F.lit("home").alias("bet"),
                            F.col("odds_home").alias("odds")).filter(F.col("odds").isNotNull()), actual)


def drawdown(bets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Largest fall of the running profit below its peak, the peak starting at 0.

    Each block of bets reduces to (profit, highest running profit, deepest fall
    inside); the blocks of a key are then chained, so a long series is not one task.
    """
    spans = hot_spans(bets, keys, order)
    rows = with_block(bets, keys, order, spans) if spans is not None else bets.withColumns(
        {BLOCK: F.lit(0).cast("long"), HOT: F.lit(False)})
    part = [*keys, BLOCK]
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_cum", F.sum("gain").over(frame))
    if spans is not None:
        total = rows.filter(HOT).groupBy(*part).agg(F.sum("gain").alias("_tot"))
        earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        base = total.select(*part, F.sum("_tot").over(earlier).alias("_base"))
        run = add_carry(run, base, keys, ["_base"]).withColumn("_cum", F.col("_cum") + F.coalesce("_base", F.lit(0.0)))
    peaked = run.withColumn("_peak", F.greatest(F.lit(0.0), F.max("_cum").over(frame)))
    # the peak of earlier blocks may top the peak inside the block; the lowest point after each
    # block's start settles it
    per_block = peaked.groupBy(*part).agg(F.max("_cum").alias("_top"), F.min("_cum").alias("_low"),
                                          F.max(F.col("_peak") - F.col("_cum")).alias("_inside"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    chained = per_block.withColumn("_earlier", F.greatest(F.lit(0.0), F.max("_top").over(before)))
    return chained.groupBy(*keys).agg(
        F.max(F.greatest("_inside", F.col("_earlier") - F.col("_low"))).alias("max_drawdown"))


def simulate(bets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bets, profit, return, hit rate, mean odds and drawdown per key."""
    agg = bets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bets"), F.sum("gain").alias("net"), F.avg("gain").alias("roi"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("odds").alias("mean_odds"))
    return agg.join(drawdown(bets, keys, order), keys)
