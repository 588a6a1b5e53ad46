"""Line dedup: lines found in many documents are removed everywhere.

Every document's distinct line hashes are counted over all documents. The distinct hashes are dealt
to shards; each shard becomes one minimal perfect hash (levels of bits, in which each hash that has
a bit for itself is placed, the others go one level down) over an array of fingerprints and an array
of counts. The documents' hashes then meet the arrays shard by shard and probe them: a shard's lines
stream past its arrays, so a task holds one shard and never a group of equal lines. Lines that make
up more than a thousandth of all line rows (there are fewer than a thousand such) are decided
by a broadcast, so no shard gets a hot line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kickline.llm.common import aside, batched, mixed, restored, row_key, table, texts_of
from kickline.llm.registry import query
from kickline.session import stage

#: Distinct lines of one shard: about 100 KB of arrays.
SHARD_LINES = 1 << 13
#: A line with more than one in so many line rows is broadcast.
HOT_SHARE = 1000
LEVELS = 24


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip().lower() for line in text.split(b"\n")]


def _hashes(keys: list[bytes]) -> list[tuple[int, int]]:
    """128 bits of every key as two signed numbers."""
    out = []
    for key in keys:
        x = xxhash.xxh3_128_digest(key)
        out.append((int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)))
    return out


def line_rows(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """One row per row of `docs` and distinct key of at least `least_chars` code points: _k1, _k2, h, f."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            at, h, f = [], [], []
            for i, body in enumerate(texts_of(batch.column(2))):
                own = {k for k in keys_of(body) if len(k) >= least_chars and (least_chars <= 1 or len(k.decode()) >= least_chars)}
                for a, b in _hashes(list(own)):
                    at.append(i)
                    h.append(a)
                    f.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())),
                                              pa.array(h, pa.int64()), pa.array(f, pa.int64())], names=["_k1", "_k2", "h", "f"])
    return docs.select("_k1", "_k2", text).mapInArrow(rows, "_k1 long, _k2 long, h long, f long")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys as levels of bits; keys left over are listed."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, start = [], 0
        for bits in levels:
            self.ranks.append(start + np.cumsum(bits) - bits)
            start += int(bits.sum())
        self.start = start

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
        return (mixed(keys ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = max(64, 2 * len(left))
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key of the set; any slot, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left]).clip(0, len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == keys[left], self.start + at, -1)
        return out

    def packed(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels], [len(b) for b in self.levels], self.rest.tobytes()

    @classmethod
    def unpacked(cls, levels: list[bytes], sizes: list[int], rest: bytes) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(np.int64) for b, n in zip(levels, sizes, strict=True)],
                   np.frombuffer(rest, np.uint64))


def _key(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    return mixed(h.view(np.uint64)) ^ f.view(np.uint64)


ARRAYS = "shard long, levels array<binary>, sizes array<int>, rest binary, prints binary, counts binary"


def build_shards(counts: DataFrame, shards: int, limit: int) -> DataFrame:
    """One row of arrays per shard from rows (h, f, n) of distinct lines; counts stop at `limit`."""
    def build(key, pdf):
        import pandas as pd
        h, f = pdf["h"].to_numpy(np.int64), pdf["f"].to_numpy(np.int64)
        keys = _key(h, f)
        mph = PerfectHash.build(keys)
        at = mph.index(keys)
        prints, n = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
        prints[at] = f.view(np.uint64) >> np.uint64(32)
        n[at] = np.minimum(pdf["n"].to_numpy(np.int64), limit)
        levels, sizes, rest = mph.packed()
        return pd.DataFrame({"shard": [key[0]], "levels": [levels], "sizes": [sizes], "rest": [rest],
                             "prints": [prints.tobytes()], "counts": [n.tobytes()]})
    return counts.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInPandas(build, ARRAYS)


def probe(lines: DataFrame, arrays: DataFrame, shards: int, limit: int) -> DataFrame:
    """The line rows whose count reaches `limit`; arrays come first in a shard, its lines stream after them."""
    kinds = [("levels", "array<binary>"), ("sizes", "array<int>"), ("rest", "binary"), ("prints", "binary"), ("counts", "binary")]
    left = arrays.select("shard", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("_k1", "_k2", "h", "f")], *[c for c, _ in kinds])
    right = lines.select(F.pmod("h", F.lit(shards)).alias("shard"), F.lit(1).alias("kind"), "_k1", "_k2", "h", "f",
                         *[F.lit(None).cast(t).alias(c) for c, t in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mph, prints, counts = None, None, None, None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(edges, np.r_[edges[1:], len(of)], strict=True):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    row = part.slice(0, 1).to_pylist()[0]
                    shard, mph = of[a], PerfectHash.unpacked(row["levels"], row["sizes"], row["rest"])
                    prints, counts = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                elif shard == of[a]:
                    h, f = part.column(4).to_numpy(), part.column(5).to_numpy()
                    at = mph.index(_key(h, f))
                    hit = (at >= 0) & (prints[at] == (f.view(np.uint64) >> np.uint64(32))) & (counts[at] >= limit)
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(hit)) for i in (2, 3, 4, 5)], names=["_k1", "_k2", "h", "f"])

    both = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, "_k1 long, _k2 long, h long, f long")


def frequent_lines(docs: DataFrame, text: str, least_docs: int, least_chars: int) -> DataFrame:
    """Per row key the hashes of its lines that are found in `least_docs` documents: _k1, _k2, gone array<binary>."""
    lines = stage(line_rows(docs, text, least_chars), "lines")
    counts = stage(lines.groupBy("h", "f").agg(F.count("*").alias("n")), "line-counts")
    size = counts.agg(F.count("*").alias("d"), F.sum("n").alias("t")).first()
    shards, hot_from = max(1, -(-size["d"] // SHARD_LINES)), (size["t"] or 0) // HOT_SHARE
    limit = min(least_docs, 2**32 - 1)
    hot = counts.filter(F.col("n") > max(hot_from, SHARD_LINES // 8))  # fewer than HOT_SHARE rows
    cold = counts.join(F.broadcast(hot.select("h", "f")), ["h", "f"], "left_anti")
    arrays = build_shards(cold, shards, limit)
    rest = lines.join(F.broadcast(hot.select("h", "f")), ["h", "f"], "left_anti")
    found = probe(rest, arrays, shards, limit).unionByName(
        lines.join(F.broadcast(hot.filter(F.col("n") >= limit).select("h", "f")), ["h", "f"]).select("_k1", "_k2", "h", "f"))
    return found.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("h", "f")).alias("gone"))


def drop_frequent_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """All columns of `docs` with the frequent lines taken out of `text`, plus _n_lines and _n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at
    least `least_chars` code points found in at least `least_docs` rows lose all their lines. Every
    row is a document, repeated rows too. A null or empty text is one empty line and comes
    back empty; an empty table gives an empty table. Other columns may have any names except
    _n_lines and _n_dropped.
    """
    named = ["_text"] + [f"_row.c{docs.columns.index(c)}" for c in ("doc_id",) if c in docs.columns and c != text]
    keyed = aside(docs, text)
    keyed = keyed.select("*", *row_key(*sorted(named, reverse=True)))
    gone = frequent_lines(keyed, "_text", least_docs, least_chars)
    fields = keyed.join(gone, ["_k1", "_k2"], "left").select("_row", "_text", "gone")
    kinds = StructType([fields.schema["_row"], StructField("_text", StringType()), StructField("_n_lines", LongType()), StructField("_n_dropped", LongType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            kept, lines, dropped = [], [], []
            for body, gone in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                parts = body.split(b"\n")
                if gone:
                    bad = {(g["h"], g["f"]) for g in gone}
                    keep = [p for p, h in zip(parts, _hashes(keys_of(body)), strict=True) if h not in bad or len(p.strip().decode()) < least_chars]
                    kept.append(b"\n".join(keep).decode())
                    dropped.append(len(parts) - len(keep))
                else:
                    kept.append(body.decode())
                    dropped.append(0)
                lines.append(len(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=["_row", "_text", "_n_lines", "_n_dropped"])

    return fields.mapInArrow(clean, kinds).select(*restored(docs.columns, text), "_n_lines", "_n_dropped")


SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY k.doc_id"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, sf_dir):
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))
