"""Exact quantiles with linear interpolation, without collecting a group, and the medians of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.windows import running


def exact_percentiles(df: DataFrame, group: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """`ps`: output -> fraction. Rows reduce to counts per distinct value before the running
    count, which runs block by block when a group has very many values."""
    key = "_all"
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(counts.withColumn(key, F.lit(1)), [key, *group], [value], sums={"_cum": "_n"})
    size = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    joined = cum.join(size, group) if group else cum.crossJoin(size)
    aggs = []
    for out, p in ps.items():
        at = F.col("_size") * 0 + p * (F.col("_size") - 1)
        aggs += [F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).alias(f"_lo_{out}"),
                 F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).alias(f"_hi_{out}")]
    agg = joined.groupBy(*group).agg(F.max("_size").alias("n"), *aggs)
    final = []
    for out, p in ps.items():
        at = p * (F.col("n") - 1)
        final.append((F.col(f"_lo_{out}") + (F.col(f"_hi_{out}") - F.col(f"_lo_{out}")) * (at - F.floor(at))).alias(out))
    return agg.select(*group, "n", *final)


POINTS, CHUNK = 1000, 1 << 16   # thinning moves a rank by at most half a POINTS-th of the rows


def _thinned(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values, each of weight one unless told, in order, and of many no more than POINTS that stand for equal shares of the weight."""
    if weights is None:
        values, n = np.sort(values), len(values)
        return (values, np.ones(n)) if n <= POINTS else (values[((np.arange(POINTS) + 0.5) * n / POINTS).astype(int)], np.full(POINTS, n / POINTS))
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    if len(values) <= POINTS:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * upto[-1] / POINTS)
    return values[np.minimum(at, len(values) - 1)], np.full(POINTS, upto[-1] / POINTS)


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The lower median of every column's numbers, None without one; nulls and NaN are left out. Exact while a task has no more than POINTS numbers
    of a column, else within a thousandth of the rows by rank.

    A task thins its rows chunk by chunk and its chunks once more; only these points are exchanged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = [[] for _ in cols], 0, [[] for _ in cols]

        def close() -> None:
            for h, d in zip(held, done, strict=True):
                d.append(_thinned(np.concatenate(h) if h else np.empty(0)))
                h.clear()

        for batch in batches:
            for i, h in enumerate(held):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                h.append(v[~np.isnan(v)])
            rows += batch.num_rows
            if rows >= CHUNK:
                close()
                rows = 0
        close()
        points = [_thinned(*(np.concatenate(x) for x in zip(*d, strict=True))) for d in done]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cols)), pa.int32()), *[pa.array([p[k].tolist() for p in points], pa.list_(pa.float64())) for k in (0, 1)]], ["col", "v", "w"])

    each = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "col int, v array<double>, w array<double>")
    points = each.select("col", F.explode(F.arrays_zip("v", "w")).alias("p")).groupBy("col", F.col("p.v").alias("v")).agg(F.sum("p.w").alias("w"))
    of = Window.partitionBy("col")   # points of all tasks, not rows
    upto = points.select("col", "v", F.sum("w").over(of.orderBy("v")).alias("upto"), F.sum("w").over(of).alias("all"))
    half = upto.filter(F.col("upto") >= F.col("all") * (0.5 - 1e-9)).groupBy("col").agg(F.min("v").alias("v")).collect()   # one row per column
    found = {r["col"]: r["v"] for r in half}
    return {c: found.get(i) for i, c in enumerate(cols)}
