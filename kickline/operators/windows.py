"""Per-entity windows that stay exact when one entity is hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kickline.operators.asof import History, asof_attach
from kickline.operators.blocks import BLOCK, HOT, add_carry, hot_spans, with_block

DAY_US = 86_400_000_000


def lookback(df: DataFrame, keys: list[str], order: list[str], back: int,
             build: Callable[[WindowSpec], dict[str, Column]], split: bool = True) -> DataFrame:
    """Adds window columns whose frames reach at most `back` rows behind the row.

    `order[0]` is the numeric time; the rest breaks ties, and cuts instants that outgrow a block. In a hot key every
    block also sees the last `back` rows before it as context. `split=False`
    skips the search for hot keys where the caller already knows there are none.
    """
    spans = hot_spans(df, keys, order) if split else None
    if spans is None:
        cols = build(Window.partitionBy(*keys).orderBy(*order))
        return df.select("*", *[c.alias(n) for n, c in cols.items()])

    rows = with_block(df, keys, order, spans)
    latest_first = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    tails = (rows.filter(HOT)
             .withColumn("_rn", F.row_number().over(latest_first)).filter(F.col("_rn") <= back)
             .groupBy(*keys, BLOCK)
             .agg(F.sort_array(F.collect_list(
                 F.struct((-F.col("_rn")).alias("_o"), F.struct(*df.columns).alias("_row")))).alias("_tail")))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-back, -1)
    context = (tails.select(*keys, BLOCK, F.flatten(F.collect_list("_tail").over(before)).alias("_prev"))
               .select(BLOCK, F.explode(F.slice("_prev", F.greatest(F.size("_prev") - back + 1, F.lit(1)),
                                                F.lit(back))).alias("_e"))
               .select("_e._row.*", BLOCK, F.lit(True).alias("_ctx")))
    both = rows.drop(HOT).withColumn("_ctx", F.lit(False)).unionByName(context)
    cols = build(Window.partitionBy(*keys, BLOCK).orderBy(*order))
    return (both.select("*", *[c.alias(n) for n, c in cols.items()])
            .filter(~F.col("_ctx")).drop("_ctx", BLOCK))


SHORT_FRAME = 5


def rolling_mean(df: DataFrame, keys: list[str], order: list[str],
                 means: dict[str, tuple[str | Column, int]], split: bool = True) -> DataFrame:
    """`means`: output -> (column, n). Mean of the last n rows, own row included; nulls are
    skipped but still count as rows.

    For short frames the statistics of a row travel as one struct, so the window
    computes a handful of lags however many means there are, and the means are
    plain arithmetic over them.
    """
    back = max(n for _, n in means.values()) - 1
    if back >= SHORT_FRAME:
        return lookback(df, keys, order, back, lambda w: {
            out: F.avg(c).over(w.rowsBetween(-(n - 1), 0)) for out, (c, n) in means.items()}, split)
    slot = {out: f"x{i}" for i, out in enumerate(means)}
    named = {}
    for out, (c, _) in means.items():   # one field per distinct named column
        if isinstance(c, str):
            slot[out] = named.setdefault(c, slot[out])
    fields = {slot[out]: (F.col(c) if isinstance(c, str) else c) for out, (c, _) in means.items()}
    packed = df.withColumn("_r0", F.struct(*[c.alias(f) for f, c in fields.items()]))
    lagged = lookback(packed, keys, order, max(back, 1),
                      lambda w: {f"_r{i}": F.lag("_r0", i).over(w) for i in range(1, back + 1)}, split)

    def mean(out: str, n: int) -> str:
        xs = [f"_r{i}.{slot[out]}" for i in range(n)]
        total = " + ".join(f"coalesce({x}, 0)" for x in xs)
        count = " + ".join(f"int({x} IS NOT NULL)" for x in xs)
        return f"try_divide({total}, {count}) AS `{out}`"

    return lagged.selectExpr(*[f"`{c}`" for c in df.columns], *[mean(o, n) for o, (_, n) in means.items()])


def lag_diff(df: DataFrame, keys: list[str], order: list[str], col: str,
             steps: dict[str, int]) -> DataFrame:
    """`steps`: output -> n, giving the value minus the value n rows earlier."""
    return lookback(df, keys, order, max(steps.values()), lambda w: {
        out: F.col(col) - F.lag(col, n).over(w) for out, n in steps.items()})


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | Column] | None = None,
            maxima: dict[str, str | Column] | None = None, counts: dict[str, str | Column] | None = None,
            ordinal: str | None = None, split: bool = True) -> DataFrame:
    """Running totals, maxima, non-null counts and the 1-based ordinal, own row included.

    In a hot key the totals of earlier blocks are added as a carry.
    """
    totals: dict[str, tuple[Callable, Column]] = {}
    for out, c in (sums or {}).items():
        totals[out] = (F.sum, F.col(c) if isinstance(c, str) else c)
    for out, c in (counts or {}).items():
        totals[out] = (F.count, F.col(c) if isinstance(c, str) else c)
    for out, c in (maxima or {}).items():
        totals[out] = (F.max, F.col(c) if isinstance(c, str) else c)
    if ordinal:
        totals[ordinal] = (F.count, F.lit(1))

    spans = hot_spans(df, keys, order) if split else None
    part = [*keys] if spans is None else [*keys, BLOCK]
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if spans is None:
        return df.select("*", *[fn(c).over(frame).alias(out) for out, (fn, c) in totals.items()])

    rows = with_block(df, keys, order, spans)
    per_block = (rows.filter(HOT).groupBy(*keys, BLOCK)
                 .agg(*[fn(c).alias(f"_c_{out}") for out, (fn, c) in totals.items()]))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.max if fn is F.max else F.sum)(f"_c_{out}").over(earlier).alias(f"_c_{out}")
               for out, (fn, _) in totals.items()]
    rows = add_carry(rows, per_block.select(*keys, BLOCK, *carried), keys, [f"_c_{o}" for o in totals])

    def merged(out: str, fn: Callable, c: Column) -> Column:
        here, before = fn(c).over(frame), F.col(f"_c_{out}")
        if fn is F.max:
            return F.greatest(here, before).alias(out)
        return F.coalesce(here + before, here, before).alias(out)

    return rows.select(*df.columns, *[merged(o, fn, c) for o, (fn, c) in totals.items()])


def running_mean(df: DataFrame, keys: list[str], order: list[str], means: dict[str, str],
                 ordinal: str | None = None, split: bool = True) -> DataFrame:
    """Expanding mean of non-null values, own row included."""
    tot = running(df, keys, order, sums={f"_s_{o}": c for o, c in means.items()},
                  counts={f"_n_{o}": c for o, c in means.items()}, ordinal=ordinal, split=split)
    keep = [*df.columns] + ([ordinal] if ordinal else [])
    return tot.select(*keep, *[F.try_divide(F.col(f"_s_{o}"), F.col(f"_n_{o}")).alias(o) for o in means])


def trailing_day_counts(df: DataFrame, keys: list[str], time: str, days: dict[str, int], split: bool = True,
                        wanted: Column | None = None) -> DataFrame:
    """Rows of the same key in the calendar frame `(t - days, t]`, own row included, of all rows or of the `wanted` ones.

    A row enters at its time and leaves every frame when that frame's days are over, so a count is a running
    sum over entries and leavings: linear however many rows a frame holds. Only the entry carries the row. In a hot
    key the sums of earlier blocks are added as a carry; blocks do not cut an instant. Rows without a time count each other.
    """
    if wanted is not None:
        undated = trailing_day_counts(df.filter(F.col(time).isNull()), keys, time, days, split).filter(wanted)
        return _counts_of_some(df.filter(F.col(time).isNotNull()), keys, time, days, split, wanted).unionByName(undated)
    whole = F.struct(*df.columns)
    none = F.lit(None).cast(df.select(whole.alias("r")).schema["r"].dataType)
    marks = [F.struct(F.col(time).cast("long").alias("_t"), F.lit(-1).alias("_of"), whole.alias("_row"))]
    marks += [F.struct((F.col(time) + n * DAY_US).cast("long").alias("_t"), F.lit(i).alias("_of"), none.alias("_row")) for i, n in enumerate(days.values())]
    dated = F.filter(F.array(*marks), lambda m: (m["_of"] < 0) | m["_t"].isNotNull())
    events = df.select(*keys, F.explode(dated).alias("_e")).select(*keys, "_e.*")
    entry = F.col("_of") < 0
    steps = {out: F.when(entry, 1).when(F.col("_of") == i, -1).otherwise(0) for i, out in enumerate(days)}

    spans = hot_spans(df, keys, time) if split else None
    part = [*[F.col(k) for k in keys], F.col("_t").isNull()]
    if spans is None:
        w = Window.partitionBy(*part).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
        counted = events.select("_of", "_row", *[F.sum(c).over(w).alias(out) for out, c in steps.items()])
        return counted.filter(entry).select("_row.*", *days)
    rows = with_block(events, keys, "_t", spans)
    per_block = (rows.filter(F.col(HOT) & F.col("_t").isNotNull()).groupBy(*keys, BLOCK)
                 .agg(*[F.sum(c).alias(f"_c_{out}") for out, c in steps.items()]))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*keys, BLOCK, *[F.sum(f"_c_{out}").over(earlier).alias(f"_c_{out}") for out in days])
    w = Window.partitionBy(*part, BLOCK).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    counted = rows.select(*keys, BLOCK, "_t", "_of", "_row", *[F.sum(c).over(w).alias(f"_n_{out}") for out, c in steps.items()]).filter(entry)
    counted = add_carry(counted, carry, keys, [f"_c_{out}" for out in days])
    before = {out: F.when(F.col("_t").isNotNull(), F.coalesce(f"_c_{out}", F.lit(0))).otherwise(0) for out in days}
    return counted.select("_row.*", *[(F.col(f"_n_{out}") + before[out]).alias(out) for out in days])


def _counts_of_some(df: DataFrame, keys: list[str], time: str, days: dict[str, int], split: bool, wanted: Column) -> DataFrame:
    """A count is the difference of two running counts, read at the row's time and at the start of its frame: only wanted rows are copied per frame."""
    numbered = running(df.select(*keys, time), keys, [time], ordinal="_n", split=split)
    at = F.col(time).cast("long") + 1   # the as-of step is strict
    rows = df.filter(wanted).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    probes = rows.select(*keys, "_copies", F.struct(*df.columns).alias("_row"), F.posexplode(F.array(at, *[at - n * DAY_US for n in days.values()])).alias("_of", "_at"))
    seen = asof_attach(probes, keys, "_at", [History(numbered, time, ["_n"], tie="_n")], split)
    read = seen.groupBy("_row", "_copies").agg(*[F.coalesce(F.max(F.when(F.col("_of") == i, F.col("_n"))), F.lit(0)).alias(f"_n{i}") for i in range(len(days) + 1)])
    return (read.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select("_row.*", *[(F.col("_n0") - F.col(f"_n{i}")).alias(out) for i, out in enumerate(days, 1)]))
