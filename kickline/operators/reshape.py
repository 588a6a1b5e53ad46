"""From matches to sides and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("home", "away")


def points(gf: str, gc: str) -> Column:
    return F.when(F.col(gf) > F.col(gc), 3).when(F.col(gf) == F.col(gc), 1).when(F.col(gf) < F.col(gc), 0)


def two_sides(df: DataFrame, keep: list[str], own_rival: dict[str, tuple[str, str]],
              flag: str = "is_home") -> DataFrame:
    """One row per side. `own_rival`: output -> (home column, away column); the away side
    takes them swapped. A single pass: the rows are generated, the input is read once."""
    def view(home: bool) -> Column:
        return F.struct(F.lit(home).alias(flag), *[
            F.col(h if home else a).alias(out) for out, (h, a) in own_rival.items()])
    return (df.select(*keep, F.explode(F.array(view(True), view(False))).alias("_v"))
            .select(*keep, "_v.*"))


def widen(df: DataFrame, keys: list[str], side: str, cols: list[str],
          prefixes: tuple[str, str] = SIDES) -> DataFrame:
    """One row per key from its side rows, with a prefix per side. A key has one row per side, so
    each side travels as one struct through a single aggregation."""
    whole = F.struct(*cols)
    packed = df.groupBy(*keys).agg(*[
        F.first(F.when(F.col(side) == p, whole), ignorenulls=True).alias(f"_{p}") for p in prefixes])
    return packed.selectExpr(*keys, *[f"_{p}.`{c}` AS `{p}_{c}`" for p in prefixes for c in cols])


def differentials(df: DataFrame, names: list[str], prefixes: tuple[str, str] = SIDES) -> DataFrame:
    a, b = prefixes
    return df.selectExpr("*", *[f"`{a}_{n}` - `{b}_{n}` AS `dif_{n}`" for n in names])


def outcome(home: str, away: str) -> Column:
    """home / draw / away, NULL where either score is missing."""
    return (F.when(F.col(home) > F.col(away), "home").when(F.col(home) == F.col(away), "draw")
            .when(F.col(home) < F.col(away), "away"))
