"""Validity intervals and aggregation of what is valid at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.windows import lookback
from kickline.session import stage

OPEN_END_US = 4_102_358_400_000_000   # fixed value: 2099-12-31


def validity(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Each row is valid from its time until the next row of the same key, else to the open end.

    Looking ahead is looking back in mirrored time, so the hot-key blocks apply here too.
    """
    mirrored = df.withColumns({"_t": -F.col(time), "_tie": -F.col(tie)})
    out = lookback(mirrored, keys, ["_t", "_tie"], 1, lambda w: {"_next": F.lag(time, 1).over(w)})
    return (out.withColumns({"valid_from": F.col(time),
                             "valid_to": F.coalesce("_next", F.lit(OPEN_END_US))})
            .drop("_t", "_tie", "_next"))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The aligned runs of instants that make up first..last, at most two per level.

    Run (l, i) holds the instants i * 2^l to (i + 1) * 2^l - 1.
    """
    nodes = []
    for lvl in range(levels + 1):
        size = 1 << lvl
        lo = F.ceil(first / size)
        hi = F.floor((last + 1) / size)
        low_odd = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1)
        lo2 = F.when(low_odd, lo + 1).otherwise(lo)
        high_odd = (lo2 < hi) & (F.pmod(hi, F.lit(2)) == 1)
        nodes.append(F.when(low_odd, F.struct(F.lit(lvl).alias("lvl"), lo.cast("long").alias("idx"))))
        nodes.append(F.when(high_odd, F.struct(F.lit(lvl).alias("lvl"), (hi - 1).cast("long").alias("idx"))))
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def valid_at(intervals: DataFrame, by: list[str], instants: DataFrame, at: str, value: str,
             sums: dict[str, Column], top_n: int | None = None) -> DataFrame:
    """Aggregates of the intervals with `valid_from <= at < valid_to`, per key and instant.

    No interval is paired with every instant it covers. The distinct instants are
    numbered; an interval is split into O(log instants) aligned runs, totals and
    the `top_n` largest values are kept per run, and an instant adds up the runs
    above it.
    """
    keep = intervals.select(*by, value, "valid_from", "valid_to", *[c.alias(o) for o, c in sums.items() if o != value])
    cal = instants.select(F.col(at).cast("long").alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    n = cal.count()
    cal, ranked = _rank_by_range(cal, keep)
    # read by the totals and by the largest values
    ranked = stage(ranked.filter(F.col("_first") <= F.col("_last")).drop("valid_from", "valid_to"), "ranked")
    levels = max(n - 1, 1).bit_length()
    runs = ranked.select("*", F.explode(_cover(F.col("_first"), F.col("_last"), levels)).alias("_n"))
    keys = [*by, "_lvl", "_idx"]
    runs = runs.select("*", F.col("_n.lvl").alias("_lvl"), F.col("_n.idx").alias("_idx")).drop("_n")
    total = runs.groupBy(*keys).agg(*[F.sum(value if o == value else o).alias(o) for o in sums],
                                    F.count(F.lit(1)).alias("n_valid"))
    if top_n:
        order = Window.partitionBy(*keys).orderBy(F.col(value).desc())
        top = (runs.select(*keys, value).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top_n)
               .groupBy(*keys).agg(F.collect_list(value).alias("_top")))
        total = total.join(top, keys)
    path = (cal.select("_at", "_i", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_lvl"))
            .withColumn("_idx", F.expr("_i >> _lvl").cast("long")))
    hit = total.join(path, ["_lvl", "_idx"])
    aggs = [F.sum(o).alias(o) for o in sums] + [F.sum("n_valid").alias("n_valid")]
    if top_n:
        aggs.append(F.flatten(F.collect_list("_top")).alias("_top"))   # at most levels * top_n values
    out = hit.groupBy(*by, F.col("_at").alias(at)).agg(*aggs)
    if top_n:
        best = F.slice(F.sort_array("_top", asc=False), 1, top_n)
        out = out.withColumn(f"top{top_n}", F.aggregate(best, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_top")
    return out


def _rank_by_range(cal: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers the distinct instants from 0, and gives every interval the first and last it covers.

    Instants and distinct ends are ranged over partitions together. A partition counts its own
    instants, the counts of those before it are its offset, so no task sees more than its range. An
    open end is after all instants and takes no part. Ends that are null cover nothing.
    """
    spark = cal.sparkSession
    last = cal.agg(F.count_if(F.col("_at") < OPEN_END_US)).first()[0] - 1
    ends = intervals.select("valid_from").union(intervals.filter(F.col("valid_to") != OPEN_END_US).select("valid_to")).toDF("_at")
    marks = (cal.select("_at", F.lit(1).alias("_is")).union(ends.filter(F.col("_at").isNotNull()).distinct().select("_at", F.lit(0)))
             .groupBy("_at").agg(F.max("_is").alias("_is")))
    # written, so that every reader sees the same borders
    ranged = stage(marks.repartitionByRange("_at").withColumn("_p", F.spark_partition_id()), "instants")
    counts = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.sum("_is").alias("n")).collect())   # one row per partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    start = spark.createDataFrame(offsets, "_p int, _before long")
    own = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (ranged.withColumn("_own", F.coalesce(F.sum("_is").over(own), F.lit(0)))
                .join(F.broadcast(start), "_p").select("_at", "_is", (F.col("_before") + F.col("_own")).alias("_i")))
    numbered = stage(numbered, "numbered")   # read by the instants and by both ends
    rank = numbered.select("_at", "_i")
    out = intervals.join(rank.toDF("valid_from", "_first"), "valid_from")
    closed = out.filter(F.col("valid_to") != OPEN_END_US).join(rank.toDF("valid_to", "_to"), "valid_to")
    still = out.filter(F.col("valid_to") == OPEN_END_US).withColumn("_last", F.lit(last).cast("long"))
    return (numbered.filter("_is = 1").select("_at", "_i"),
            closed.withColumn("_last", F.col("_to") - 1).drop("_to").unionByName(still))


def _lower_bound(grid: Column, x: Column, steps: int = 24) -> Column:
    """How many grid instants are before x, by bisection over the sorted array."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        inside = s["lo"] < s["hi"]
        less = F.get(grid, mid) < x
        return F.struct(F.when(inside & less, mid + 1).otherwise(s["lo"]).cast("int").alias("lo"),
                        F.when(inside & ~less, mid).otherwise(s["hi"]).cast("int").alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.size(grid).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, halve, lambda s: s["lo"])
