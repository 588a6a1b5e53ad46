"""Splitting the history of a hot key into blocks of about equal row counts.

A window partitioned by an entity puts the whole history of that entity in one
task. `hot_spans` finds the keys with more rows than one task should hold and
gives each borders at the quantiles of its own instants, so a burst of rows is
cut as often as it needs; an instant that alone outgrows a block is cut by the
tie-break after it. Everything else stays in a single block. The windows in
`windows.py` and `asof.py` run inside a block and carry what they need across
the block border, so results do not depend on the blocks.

The table of hot spans has at most rows / rowsPerBlock rows with as many borders
as OVERSPLIT blocks per rowsPerBlock rows need, and the tables of blocks a few times
as many, whatever the skew. That is the size bound behind the broadcasts here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kickline.session import stage

ROWS_PER_BLOCK = "spark.kickline.rowsPerBlock"
DEFAULT_ROWS_PER_BLOCK = 4_000_000
OVERSPLIT = 4

BLOCK, HOT = "_blk", "_hot"


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BLOCK, str(DEFAULT_ROWS_PER_BLOCK)))


def _order_of(df: DataFrame, order: str | list[str]) -> tuple[str, str | None]:
    """The time and the first tie-break, the latter only if it has quantiles."""
    names = [order] if isinstance(order, str) else order
    kind = dict(df.dtypes)
    cuttable = len(names) > 1 and kind[names[1]].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")
    return names[0], names[1] if cuttable else None


def _position(time: Column, side: Column, tie: Column) -> Column:
    """Where a row or a border stands: a border lies before (-1), within (0) or after (1) the rows of its instant."""
    return F.struct(time.alias("t"), side.cast("int").alias("side"), tie.alias("tie"))


def hot_spans(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame | None:
    """`keys, _borders` for every key that outgrows one block, else None.

    `order` is the time, or the time and its tie-breaks. The grouped count is the only job where no key is
    hot. The borders are written once, so every reader sees the same ones.
    """
    limit = rows_per_block(df.sparkSession)
    time, tie = _order_of(df, order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    pieces = -(-most // limit) * OVERSPLIT
    second = F.col(tie) if tie else F.lit(None).cast("int")
    rows = df.filter(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_time"), second.alias("_second"))
    hot = rows.alias("d").join(F.broadcast(sizes.alias("s")), same_key("d", "s", keys)).select("d.*", "s._n")

    def cuts(of: str, n: int) -> Column:
        return F.percentile_approx(of, F.lit([i / n for i in range(1, n)]), 20 * n + 10_000)

    def thinned(found: str, n: int, wanted: Column) -> Column:
        """Of n - 1 cuts about as many as `wanted` pieces need."""
        step = F.greatest(F.lit(1), F.floor(F.lit(n) / wanted)).cast("int")
        return F.filter(found, lambda x, i: F.pmod(i + 1, step) == 0)

    per_key = hot.groupBy(*keys).agg(F.max("_n").alias("_n"), cuts("_time", pieces).alias("_c"))
    cut = per_key.select(*keys, F.explode(thinned("_c", pieces, F.ceil(F.col("_n") / limit) * OVERSPLIT)).alias("_time")).groupBy(*keys, "_time").agg(F.count(F.lit(1)).alias("_times"))
    cut = stage(cut, "cuts")
    none = F.lit(None).cast(rows.schema["_second"].dataType)
    borders = cut.select(*keys, _position(F.col("_time"), F.lit(1), none).alias("_b"))
    heavy = cut.filter(F.col("_times") > 1)
    widest = heavy.agg(F.max("_times")).first()[0] if tie else None
    if widest is not None:
        # instants that hold several cuts: they stand alone and are cut by the tie-break
        n = widest + 1
        within = (hot.alias("d").join(F.broadcast(heavy.alias("s")), same_key("d", "s", [*keys, "_time"])).select("d.*", "s._times")
                  .groupBy(*keys, "_time").agg(F.max("_times").alias("_times"), cuts("_second", n).alias("_c")))
        inner = within.select(*keys, "_time", F.explode(thinned("_c", n, F.col("_times") + 1)).alias("_second")).distinct()
        borders = (borders.union(heavy.select(*keys, _position(F.col("_time"), F.lit(-1), none)))
                   .union(inner.select(*keys, _position(F.col("_time"), F.lit(0), F.col("_second")))))
    return stage(borders.groupBy(*keys).agg(F.sort_array(F.collect_list("_b")).alias("_borders")), "hot-spans")


def same_key(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def with_block(df: DataFrame, keys: list[str], order: str | list[str], spans: DataFrame) -> DataFrame:
    """Adds the block number, the count of borders before the row, and whether the key is hot. Rows without a time fall in block 0."""
    time, tie = _order_of(df, order)
    d, s = df.alias("d"), F.broadcast(spans.alias("s"))
    longest = spans.agg(F.max(F.size("_borders"))).first()[0]
    halves = [1 << i for i in range(longest.bit_length() - 1, -1, -1)]
    # spans cut without a tie-break have a null of another type there
    second = F.col(f"d.{tie}") if tie else F.lit(None)
    here = _position(F.col(f"d.{time}"), F.lit(0), second.cast(spans.schema["_borders"].dataType.elementType["tie"].dataType))
    # binary search: steps of falling powers of two, past the end there is no border to pass
    block = F.aggregate(F.lit(halves), F.lit(0).cast("int"), lambda at, h: F.when(F.get("s._borders", at + h - 1) < here, at + h).otherwise(at))
    return (d.join(s, same_key("d", "s", keys), "left")
            .select("d.*", F.when(F.col("s._borders").isNull(), 0).otherwise(block).cast("long").alias(BLOCK), F.col("s._borders").isNotNull().alias(HOT)))


def add_carry(df: DataFrame, carry: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Joins per-block carry values; `carry` has one row per block of a hot key."""
    on = keys + [BLOCK]
    d, c = df.alias("d"), F.broadcast(carry.alias("c"))
    return d.join(c, same_key("d", "c", on), "left").select("d.*", *[F.col(f"c.{x}") for x in cols])
