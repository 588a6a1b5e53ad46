"""Exact top-k search by tiled matrix products.

Rows are dealt to shards and queries to blocks of a fixed size; a tile is one block against one
shard: a matrix product of whole numbers, of which every query keeps its k largest by partial
selection. The lists of a query are merged along a tree with a fixed fan-in, so no task ever holds
more than one tile or a few lists, however many rows or queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kickline.llm.common import groups, table
from kickline.llm.registry import query
from kickline.session import stage

#: Factor of the quantisation (fixed by the contract).
SCALE = 256
#: Rows of a shard and queries of a block, on average; a tile moves both and multiplies all by all.
SHARD, ASKED = 8192, 4096
#: Queries multiplied at a time within a tile.
STRIP = 256
#: Lists merged by one node of the tree.
FAN_IN = 32
#: Whole numbers below this are exact in double precision.
EXACT = 1 << 53
LONG = np.iinfo(np.int64)


def quantised(vector: str) -> Column:
    """floor(SCALE * x) of every component as a long; null for a vector that is null or holds null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def products(asked: np.ndarray, have: np.ndarray) -> np.ndarray:
    """All inner products, exact: in double precision where no sum can leave its whole numbers, else in Python's; outside a long they stay at its ends."""
    reach = max(asked.shape[1], 1) * float(np.abs(asked.astype(float)).max(initial=0)) * float(np.abs(have.astype(float)).max(initial=0))
    if reach < EXACT:
        return asked.astype(float) @ have.astype(float).T
    return np.clip(asked.astype(object) @ have.astype(object).T, int(LONG.min), int(LONG.max)).astype(np.int64)


def largest(scores: np.ndarray, banned: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k largest of every row that are not banned, the earlier column first at ties; fewer if there are fewer."""
    rows, width = scores.shape
    if scores.dtype == float and np.abs(scores).max(initial=0) * 2 * width < EXACT:
        order = scores * width + np.arange(width - 1, -1, -1)  # no two of a row are equal, so a partial selection is exact
        order[banned] = -np.inf
        keep = np.argpartition(order, width - k, axis=1)[:, width - k:] if k < width else np.broadcast_to(np.arange(width), (rows, width))
        value = np.take_along_axis(order, keep, 1)
        at = np.argsort(-value, axis=1)
        keep, value = np.take_along_axis(keep, at, 1), np.take_along_axis(value, at, 1)
        return [a[v > -np.inf] for a, v in zip(keep, value, strict=True)]
    out = []
    for row, no in zip(scores, banned, strict=True):
        on = np.flatnonzero(~no)
        # from the last column on, stable and ascending: read backwards, ties come in column order
        out.append(on[::-1][np.argsort(row[on][::-1], kind="stable")][::-1][:k])
    return out


def tile(both: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(asked, at, ids, scores) of the queries of a tile; columns of `both`: g, p, kind, id, at, v."""
    kind = both["kind"].to_numpy()
    ask, have = both.filter(pa.array(kind == 1)), both.filter(pa.array(kind == 0))
    size = ask["v"].combine_chunks().value_lengths().to_numpy() if ask.num_rows else np.zeros(0, int)
    wide = have["v"].combine_chunks().value_lengths().to_numpy() if have.num_rows else np.zeros(0, int)
    for dim in np.unique(size):  # vectors of other lengths have no product
        mine, own = ask.filter(pa.array(size == dim)), have.filter(pa.array(wide == dim))
        if not own.num_rows:
            continue
        ids = own["id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        entry, asked, names = matrix(own)[by_id], matrix(mine), mine["id"].to_numpy()
        for s in range(0, len(asked), STRIP):
            name = names[s:s + STRIP]
            scores = products(asked[s:s + STRIP], entry)
            best = largest(scores, ids[None, :] == name[:, None], min(k, len(ids)))
            found = [ids[b] for b in best]
            values = [row[b].astype(np.int64) for row, b in zip(scores, best, strict=True)]
            yield pa.RecordBatch.from_arrays([mine["id"].combine_chunks().slice(s, STRIP), mine["at"].combine_chunks().slice(s, STRIP), pa.array([both["p"][0].as_py()] * len(name), pa.int64()),
                                              pa.array(found, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))], names=["id", "at", "p", "ids", "scores"])


def merged(lists: DataFrame, k: int, fan_in: int) -> DataFrame:
    """One level of the tree: the k best of up to `fan_in` neighbouring lists of a query, ties to the smaller id."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return lists.groupBy("id", "at", F.floor(F.col("p") / fan_in).cast("long").alias("p")).agg(best.alias("best"))


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, asked: int = ASKED, fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query row with all other rows, ties to the smaller id.

    Components become floor(256 * x) (the ends of a long, if outside). Null vectors, vectors with null or
    non-finite components and rows with a null key take no part; zero vectors do. Repeated rows count once; two
    vectors under one key are two candidates, and two queries with a list each, neither of them a candidate of that key. Only
    vectors of the same length have a product. All candidates come back if there are fewer than k; a query without
    any has no row; an empty table gives an empty result. Other columns are not read. `key` is a whole number.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    named = F.col(f"`{key.replace('`', '``')}`")
    kept = (rows.select(named.cast("long").alias("id"), F.col(f"`{vector.replace('`', '``')}`").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
            .select("id", quantised("x").alias("v"), "q").filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.max("q").alias("q"))
            .withColumn("at", F.xxhash64("id", "v")))
    entries = stage(kept, "entries")
    size = entries.agg(F.count("*").alias("rows"), F.count_if("q").alias("asked")).first()
    if not size["asked"]:
        return rows.sparkSession.createDataFrame([], schema)
    shards, blocks = -(-size["rows"] // shard), -(-size["asked"] // asked)

    # a row meets every block of queries once, a query every shard once: the tiles
    def dealt(df: DataFrame, kind: int, g: Column, p: Column) -> DataFrame:
        return df.select(g.alias("g"), p.alias("p"), F.lit(kind).alias("kind"), "id", "at", "v")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = (dealt(entries, 0, all_of(blocks), F.pmod("at", F.lit(shards)))
           .unionByName(dealt(entries.filter("q"), 1, F.pmod(F.xxhash64("at"), F.lit(blocks)), all_of(shards))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in groups(batches, 2):
            yield from tile(both, k)
    # tiles are few rows and much work: each goes to a task of its own, up to a few thousand at once
    tasks = min(shards * blocks, 4096)
    tiles = (met.repartitionById(tasks, F.pmod(F.col("g") * shards + F.col("p"), F.lit(tasks)).cast("int")).sortWithinPartitions("g", "p")
             .mapInArrow(run, "id long, at long, p long, ids array<long>, scores array<long>"))
    # negated scores: the plain order of the pairs is the order of the ranks (-1 - x, as a long has no -min)
    lists = stage(tiles.select("id", "at", "p", F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct(F.bitwise_not(x["scores"]).alias("low"), x["ids"].alias("vec_id"))).alias("best")), "lists")
    wide = shards
    while wide > 1:
        lists = merged(lists, k, fan_in)
        wide = -(-wide // fan_in)
    return (lists.select(F.col("id").alias("query_id"), F.posexplode("best").alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", F.bitwise_not("x.low").alias("score")))


@query("op11_tiled_top_k", """
WITH kept AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.vec_id AS query_id, a.v AS q, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM met
)
SELECT * FROM ranked WHERE rank <= 5""")
def op11_tiled_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
