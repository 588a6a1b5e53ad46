"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is the set of (depth, turn) pairs of a prefix, named by two exclusive-or sums of their
hashes; running sums give the names of all prefixes of a conversation. Conversations are cut where
range partitions end and the sums are carried over, so a long one is no single task. Subtree totals
come from rounds of joins: leaves are raked into their parents, then the locally smallest nodes of
unary chains are compressed out of them; the contracted nodes are re-expanded in the opposite order.
A chain of length n is gone after about log2(n) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kickline.llm.common import table
from kickline.llm.registry import query
from kickline.session import stage

#: Conversations of a group share their first turns; a conversation takes fewer than HEADS of them (fixed by the contract).
GROUP, HEADS = 20, 4
#: A word (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"
#: Parents with more children than this share of all nodes are looked up in a broadcast table, which so has at most as many rows.
HOT_SHARE, HOT_LEAST = 10_000, 1000
NODE = ["depth", "p1", "p2"]


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def _xor(*columns) -> Column:
    first, *rest = [F.col(c) if isinstance(c, str) else c for c in columns]
    for c in rest:
        first = first.bitwiseXOR(c)
    return first


def _marks(depth, t1, t2) -> list[Column]:
    """Two hashes of a turn at its depth."""
    return [F.xxhash64(depth, t1, t2).alias("x1"), F.xxhash64(F.lit("second"), depth, t2, t1).alias("x2")]


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(c, depth, p1, p2, q1, q2, words, last): a row per prefix of every rebuilt conversation, the empty one included.

    p names the prefix, q the one before it, words counts those of its last text, last marks the whole conversation.
    """
    role_, text_ = (F.coalesce(_name(x).cast("string"), F.lit("")) for x in (role, text))
    rows = stage(turns.select(_name(conv).cast("long").alias("c"), _name(turn).alias("t"), F.xxhash64(role_, text_).alias("t1"), F.xxhash64(F.lit("second"), role_, text_).alias("t2"),
                              F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words")).filter("c IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()), "turns")
    order = [F.col("t").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("uid")]
    dealt = stage(rows.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()), "dealt")

    # one row per conversation and range partition: what lies before it, and what the conversation takes from its group
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(dealt.groupBy("c", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pieces")
    first = Window.partitionBy("c").orderBy(*order)
    base = (rows.filter(F.col("c") % group == 0).withColumn("i", F.row_number().over(first).cast("long")).filter(F.col("i") < heads)
            .select(F.col("c").alias("base"), "i", "words", *_marks("i", "t1", "t2"))
            .groupBy("base").agg(F.sort_array(F.collect_list(F.struct("i", "x1", "x2", "words"))).alias("head")))
    own_share = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    whole = (pieces.groupBy("c").agg(F.sum("n").alias("turns")).withColumn("h", own_share).withColumn("base", F.col("c") - F.col("c") % group).join(base, "base", "left")
             .withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h").cast("int"))).otherwise(F.array().cast("array<struct<i:long,x1:long,x2:long,words:long>>")))
             .withColumn("m", F.size("head").cast("long")))

    def sum_of(name: str, upto: Column) -> Column:
        return F.aggregate(F.filter("head", lambda x: x["i"] <= upto), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[name]))
    whole = stage(whole.select("c", "turns", "h", "m", "head", sum_of("x1", F.col("m")).alias("h1"), sum_of("x2", F.col("m")).alias("h2")), "whole")

    within = Window.partitionBy("c", "part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    known = pieces.join(whole.drop("head"), "c").drop("n")
    placed = dealt.withColumn("j", F.row_number().over(within)).join(known, ["c", "part"]).withColumn("j", F.col("j") + F.col("before"))
    placed = placed.filter("j > h").withColumn("depth", F.col("m") + F.col("j") - F.col("h")).withColumns(dict(zip(("x1", "x2"), _marks("depth", "t1", "t2"), strict=True)))
    own = stage(placed.select("c", "part", "depth", "x1", "x2", "words", (F.col("j") == F.col("turns")).alias("last"), _xor(F.bit_xor("x1").over(running), "h1").alias("p1"), _xor(F.bit_xor("x2").over(running), "h2").alias("p2")), "own")
    # only the first conversation of a range partition can have begun in an earlier one: at most a row per partition
    carried = (own.groupBy("c", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
               .select("c", "part", F.bit_xor("s1").over(earlier).alias("s1"), F.bit_xor("s2").over(earlier).alias("s2")).filter("s1 IS NOT NULL"))
    zero = F.lit(0).cast("long")
    own = (own.join(F.broadcast(carried), ["c", "part"], "left")
           .withColumns({"p1": _xor("p1", F.coalesce("s1", zero)), "p2": _xor("p2", F.coalesce("s2", zero))}))

    none = F.lit(None).cast("long")
    roots = whole.select("c", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("words"), ((F.col("m") == 0) & (F.col("turns") <= F.col("h"))).alias("last"))
    taken = (whole.select("*", F.explode("head").alias("x"))
             .select("c", F.col("x.i").alias("depth"), sum_of("x1", F.col("x.i")).alias("p1"), sum_of("x2", F.col("x.i")).alias("p2"), "x.x1", "x.x2", "x.words",
                     ((F.col("x.i") == F.col("m")) & (F.col("turns") <= F.col("h"))).alias("last")))
    step = ["c", "depth", "p1", "p2", _xor("p1", "x1").alias("q1"), _xor("p2", "x2").alias("q2"), "words", "last"]
    return roots.unionByName(taken.select(*step)).unionByName(own.select(*step))


def tree_of(steps: DataFrame) -> DataFrame:
    """(conv, depth, pconv, n_convs, n_children, words, p1, p2): a row per node; conv is its smallest member, pconv its parent's."""
    found = steps.groupBy(*NODE).agg(F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    found = stage(found, "found")
    kids = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = stage(found.join(kids, NODE, "left").fillna(0, ["n_children"]), "nodes")
    hot = max(HOT_LEAST, nodes.count() // HOT_SHARE)
    up = [(F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("pconv")]
    below = nodes.filter("depth > 0").join(F.broadcast(nodes.filter(F.col("n_children") > hot).select(*up)), ["depth", "q1", "q2"], "left")
    rest = below.filter("pconv IS NULL").drop("pconv").join(nodes.filter(F.col("n_children").between(1, hot)).select(*up), ["depth", "q1", "q2"])
    top = nodes.filter("depth = 0").withColumn("pconv", F.lit(None).cast("long"))
    whole = top.unionByName(below.filter("pconv IS NOT NULL")).unionByName(rest)
    return stage(whole.select("conv", "depth", "pconv", "n_convs", "n_children", "words", "p1", "p2"), "tree")


def subtree_sums(tree: DataFrame, weights: list[str]) -> DataFrame:
    """(conv, depth, *weights): the sums of the long columns `weights` over the subtree of every node (conv, depth), which hangs below (pconv, depth - 1) or, if pconv is null, is a root.

    An active node holds what was raked into it (w) and what lies between it and its present parent (e).
    """
    node, zero = ["conv", "depth"], F.lit(0).cast("long")
    extra = [f"e_{w}" for w in weights]
    now = tree.select(*node, "pconv", (F.col("depth") - 1).alias("pdepth"), *weights, *[zero.alias(e) for e in extra])
    raked, compressed = [], []
    while True:
        kids = (now.filter("pconv IS NOT NULL").groupBy("pconv", "pdepth").agg(F.count("*").alias("n"), F.min(F.struct(*node)).alias("only"))
                .select(F.col("pconv").alias("conv"), F.col("pdepth").alias("depth"), "n", "only"))
        # chains lose every second node by their depth, whatever is left of them; the hash only breaks ties
        zeros = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1).cast("long")
        rank = F.shiftleft(zeros, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*node), 8))
        known = stage(now.join(kids, node, "left").withColumn("rank", F.when((F.col("n") == 1) & F.col("pconv").isNotNull(), rank)), "known")
        leaves, chain = known.filter("n IS NULL"), known.filter("rank IS NOT NULL")
        raked.append(leaves.select(*node, *weights))
        parent = [F.col("pconv").alias("conv"), F.col("pdepth").alias("depth")]
        notes = (leaves.filter("pconv IS NOT NULL").select(*parent, F.lit(-1).cast("long").alias("rank"), *[(F.col(w) + F.col(e)).alias(w) for w, e in zip(weights, extra, strict=True)])
                 .unionByName(chain.select(*parent, "rank", *[zero.alias(w) for w in weights]))
                 .unionByName(chain.select("only.conv", "only.depth", "rank", *[zero.alias(w) for w in weights])))
        heard = notes.groupBy(*node).agg(F.min("rank").alias("least"), *[F.sum(w).alias(f"u_{w}") for w in weights])
        leaves_out = F.col("rank").isNotNull() & (F.col("least").isNull() | (F.col("rank") < F.col("least")))
        after = stage(known.filter("n IS NOT NULL").join(heard, node, "left")
                      .select(*node, "pconv", "pdepth", "only", *[(F.col(w) + F.coalesce(f"u_{w}", zero)).alias(w) for w in weights], *extra, leaves_out.alias("out")), "after")
        out = after.filter("out").select(F.col("only.conv").alias("conv"), F.col("only.depth").alias("depth"), F.col("conv").alias("oconv"), F.col("depth").alias("odepth"), F.col("pconv").alias("gconv"), F.col("pdepth").alias("gdepth"),
                                         *[F.col(w).alias(f"o_{w}") for w in weights], *[F.col(e).alias(f"o_{e}") for e in extra])
        moved = stage(after.filter("NOT out").drop("out", "only").join(out, node, "left"), "moved")
        compressed.append(moved.filter("oconv IS NOT NULL").select("oconv", "odepth", *node, *[(F.col(f"o_{w}") + F.col(e)).alias(f"o_{w}") for w, e in zip(weights, extra, strict=True)]))
        if moved.isEmpty():
            break
        given = F.col("oconv").isNotNull()
        now = moved.select(*node, F.when(given, F.col("gconv")).otherwise(F.col("pconv")).alias("pconv"), F.when(given, F.col("gdepth")).otherwise(F.col("pdepth")).alias("pdepth"), *weights,
                           *[F.when(given, F.col(e) + F.col(f"o_{w}") + F.col(f"o_{e}")).otherwise(F.col(e)).alias(e) for w, e in zip(weights, extra, strict=True)])
    totals = None
    for leaves, gone in zip(reversed(raked), reversed(compressed), strict=True):
        totals = leaves if totals is None else totals.unionByName(leaves)
        back = gone.join(totals, node).select(F.col("oconv").alias("conv"), F.col("odepth").alias("depth"), *[(F.col(f"o_{w}") + F.col(w)).alias(w) for w in weights])
        totals = totals.unionByName(stage(back, "back"))
    return totals


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of rows (depth, p1, p2, c): a digest is sequential, so a node's ids stream past one at a time and only its state is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            ids = batch.column(3).to_pylist()
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)].tolist()
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                own = tuple(key[a].tolist())
                if own == held:
                    state.update(b",")
                else:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = own, hashlib.sha256()
                state.update(",".join(map(str, ids[a:b])).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], names=[*NODE, "ends_sha256"])
    return ends.select(*NODE, "c").repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie.

    Conversation c is rebuilt from the first h turns of c - c % `group` (h = crc32 of the decimal c modulo `heads`) and its own
    after its first h. Turns go by `turn`, null first; equal ones by fixed hashes of role and text, whatever the
    layout. Null role and text are empty; rows with a null conversation take no part; repeated rows are turns of their own. A
    conversation may end up without turns and is then a member of the root only. An empty table has no node. Other
    columns are not read. Ids are whole numbers; % has the sign of the dividend.
    """
    steps = stage(paths(turns, conv, turn, role, text, group, heads), "steps")
    tree = tree_of(steps)
    weighed = tree.select("conv", "depth", "pconv", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    out = tree.join(totals, ["conv", "depth"]).join(ends_digest(steps.filter("last")), NODE, "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op12_prefix_trie", r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS turns, c - c % 20 AS b, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(str_split(c::VARCHAR, ''), lambda d: [1000 + ascii(d), 0, 0, 0, 0, 0, 0, 0, 0])),
         lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM turns GROUP BY c
), built AS (
  SELECT v.c, t.j, t.t, t.words, 0 AS own FROM convs v JOIN turns t ON t.c = v.b AND t.j <= v.h
  UNION ALL SELECT v.c, t.j, t.t, t.words, 1 FROM convs v JOIN turns t ON t.c = v.c AND t.j > v.h
), numbered AS (
  SELECT c, t, words, row_number() OVER (PARTITION BY c ORDER BY own, j) AS depth FROM built
), steps AS (
  SELECT c, depth, words, string_agg(t, '') OVER (PARTITION BY c ORDER BY depth) AS p FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs
), ended AS (
  SELECT c, max(depth) AS depth FROM steps GROUP BY c
), ends AS (
  SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM steps JOIN ended USING (c, depth) GROUP BY p
), nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, CASE WHEN depth > 0 THEN p[:64 * (depth - 1)] END AS q FROM steps GROUP BY p, depth
), kids AS (
  SELECT q AS p, count(*) AS n_children FROM nodes WHERE q IS NOT NULL GROUP BY q
), weighed AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kids USING (p)
), summed AS (
  SELECT a.p, sum(w.leaf)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
  FROM weighed w JOIN steps a ON a.c = w.conv_id AND a.depth <= w.depth GROUP BY a.p
)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM weighed w JOIN summed USING (p) LEFT JOIN nodes u ON u.p = w.q LEFT JOIN ends e ON e.p = w.p""")
def op12_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))
