"""First, last and best rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.quantiles import exact_percentiles


def last_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns; an aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def top_sum(df: DataFrame, keys: list[str], value: str, n: int, out: str) -> DataFrame:
    """Sum of the n largest values. The rank filter also prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    return (df.select(*keys, value).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .groupBy(*keys).agg(F.sum(value).alias(out)))


def best_point(df: DataFrame, keys: list[str], params: list[str], loss: str) -> DataFrame:
    """Grid point of least loss, the smaller parameters on ties."""
    return (df.groupBy(*keys).agg(F.min(F.struct(loss, *params)).alias("_b"))
            .select(*keys, *[F.col(f"_b.{p}").alias(p) for p in params], F.col(f"_b.{loss}").alias(loss)))


def most_confident(df: DataFrame, score: str, share: float) -> DataFrame:
    """Rows at or above the exact quantile that leaves `share` of them."""
    edge = exact_percentiles(df, [], score, {"_edge": 1 - share}).select("_edge")
    return df.crossJoin(F.broadcast(edge)).filter(F.col(score) >= F.col("_edge")).drop("_edge")   # one row
