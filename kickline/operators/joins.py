"""Joins with declared cardinality, lookups and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


class CardinalityError(ValueError):
    pass


def sized_broadcast(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hints a broadcast after counting; above the bound the plan stays a shuffled join,
    where adaptive execution splits skewed partitions."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                 one_to_one: bool = False, keep_all: bool = False) -> DataFrame:
    """Join that fails when the right side repeats a key (or the left too, with `one_to_one`),
    or when `keep_all` and an inner join would lose rows of the left side."""
    if not duplicate_keys(right, on).isEmpty():
        raise CardinalityError(f"right side repeats {on}")
    if one_to_one and not duplicate_keys(left, on).isEmpty():
        raise CardinalityError(f"left side repeats {on}")
    if keep_all:
        lost = left.join(right, on, "left_anti")
        if not lost.isEmpty():
            raise CardinalityError(f"{lost.count()} rows have no partner on {on}")
    return left.join(right, on, how)


def fill_gaps(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of `primary`, plus the rows of `secondary` whose key group `primary` lacks."""
    have = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(have, keys, "left_anti"), allowMissingColumns=True)


def coverage(left: DataFrame, right: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """Rows, matched rows and their share by group."""
    mark = right.select(*on).distinct().withColumn("_hit", F.lit(1))
    return (left.join(mark, on, "left").groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("matched"))
            .withColumn("rate", F.col("matched") / F.col("n")))


def coverage_rate(left: DataFrame, right: DataFrame, on: list[str], where: Column) -> DataFrame:
    """One row: share of matched rows among those that satisfy `where`; 1.0 when there are none."""
    mark = right.select(*on).distinct().withColumn("_hit", F.lit(1))
    return (left.filter(where).join(mark, on, "left")
            .agg(F.coalesce(F.avg(F.when(F.col("_hit").isNotNull(), 1.0).otherwise(0.0)),
                            F.lit(1.0)).alias("rate")))


def opponent_value(df: DataFrame, game: list[str], team: str, cols: dict[str, str]) -> DataFrame:
    """Adds the other side's value in the same game, `cols`: output -> column; NULL without a rival.

    A game has at most two rows, so one aggregation holds both sides and hands
    each its rival's values: no self-join. More than two rows is an error.
    """
    rest = [c for c in df.columns if c not in game and c != team]
    side = F.struct(team, *rest)
    packed = df.groupBy(*game).agg(F.count(F.lit(1)).alias("_n"), F.max(side).alias("_a"), F.min(side).alias("_b"))

    def view(own: str, other: str | None) -> Column:
        rival = [(F.col(f"{other}.{c}") if other else F.lit(None).cast(dict(df.dtypes)[c])).alias(o) for o, c in cols.items()]
        return F.struct(*[F.col(f"{own}.{c}").alias(c) for c in (team, *rest)], *rival)

    sides = (F.when(F.col("_n") == 1, F.array(view("_a", None)))
             .when(F.col("_n") == 2, F.array(view("_a", "_b"), view("_b", "_a")))
             .otherwise(F.raise_error(F.lit(f"a game ({', '.join(game)}) has more than two sides"))))
    return packed.select(*game, F.explode(sides).alias("_s")).select(*game, "_s.*").select(*df.columns, *cols)
