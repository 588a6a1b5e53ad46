"""Descriptive tables: shares, nulls, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_shares(df: DataFrame, group: list[str], cls: str, classes: list[str]) -> DataFrame:
    n = df.filter(F.col(cls).isNotNull()).groupBy(*group).pivot(cls, classes).count().fillna(0)
    total = sum((F.col(c) for c in classes), F.lit(0))
    return n.select(*group, *[(F.col(c) / total).alias(c) for c in classes])


def null_profile(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Long table of nulls and coverage per column, from a single pass."""
    agg = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_{c}") for c in cols])
    return (agg.select(*group, "n_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("_k")) for c in cols])).alias("x"))
        .select(*group, "x.column_name", "n_rows", (F.col("n_rows") - F.col("x._k")).alias("n_null"),
                (F.col("x._k") / F.col("n_rows")).alias("coverage")))


def drift_table(df: DataFrame, group: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Mean of the group means and their relative range."""
    per = df.groupBy(*group).agg(*[F.avg(c).alias(n) for n, c in metrics.items()])
    agg = per.agg(*[F.struct(F.lit(n).alias("metric"), F.avg(n).alias("mean"),
                             ((F.max(n) - F.min(n)) / F.avg(n)).alias("variation")).alias(n) for n in metrics])
    return agg.select(F.explode(F.array(*metrics)).alias("x")).select("x.*")


def share_by(df: DataFrame, by: str, value: str) -> DataFrame:
    g = df.groupBy(by).agg(F.sum(value).alias("total"))
    return g.crossJoin(g.agg(F.sum("total").alias("_all"))).select(by, "total", (F.col("total") / F.col("_all")).alias("share"))
