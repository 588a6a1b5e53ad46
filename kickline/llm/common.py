"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, the only characters that separate words: space and \x09-\x0D (fixed by the contracts).
SPACE = " \t\n\x0b\f\r"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> list:
    """Two 64-bit hashes that tell rows apart by the given columns; a null is a value of its own."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*marked).alias("_k1"), F.xxhash64(F.lit("second"), *marked).alias("_k2")]


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def aside(df: DataFrame, text: str) -> DataFrame:
    """`df` as two columns, `_row` (a struct of all other columns, under numbers) and `_text`.

    An operator may then name its own columns as it likes, whatever the names in `df`.
    """
    rest = [F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    return df.select(F.struct(*rest, F.lit(True).alias("row")).alias("_row"), F.col(_quoted(text)).alias("_text"))


def restored(columns: list[str], text: str, body: str | None = "_text") -> list:
    """The columns set aside under their own names, `text` from the column `body`, or left out if that is None."""
    return [F.col(f"_row.c{i}").alias(c) if c != text else F.col(body).alias(c) for i, c in enumerate(columns) if c != text or body]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordValues(dict):
    """Word (bytes) -> 64-bit value, remembered for the frequent words; holds about `most_bytes` at a time."""

    def __init__(self, most_bytes: int = 32_000_000):
        self.most_bytes, self.held = most_bytes, 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 150  # the entry, the number and the heads of both objects
        if self.held > self.most_bytes:
            self.clear()
            self.held = len(word) + 150
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of all windows of consecutive values, by prefix sums of a polynomial modulo 2^64.

    The base is odd and so has an inverse; equal windows get equal hashes wherever they start.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) <= n:
            m = max(n + 1, 2 * len(self.powers))
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, b, np.uint64), dtype=np.uint64)])
            self.powers, self.inverses = grow(self.base), grow(self.inverse)

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        n = len(values)
        if n < width:
            return np.zeros(0, np.uint64)
        self._reach(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], dtype=np.uint64, out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * self.inverses[:n - width + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def batched(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the rows handled together stay small, whatever the texts' lengths."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows equal in the first `keys` (long) columns of sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        if held and not np.array_equal(np.array([held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(keys)]), of[0]):
            yield pa.Table.from_batches(held)
            held = []
        edges = np.r_[0, np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1, len(of)].tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(of):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Bitmap:
    """A set of 64-bit hashes as bits, two for each hash: no false negatives.

    Used to skip rows ahead of an exact step only. A table too large for the bits makes it skip
    less; results do not change.
    """

    #: Bytes of the pieces in which tasks hand their bits on.
    PIECE = 1 << 16

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def bits_for(rows: int, least: int = 1 << 20, most: int = 1 << 28) -> int:
        """Sixteen bits a row as a power of two; from 32 MB on the set gets fuller instead of larger."""
        return min(most, max(least, 1 << (16 * max(rows, 1) - 1).bit_length()))

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 1 << 26) -> Bitmap:
        """Every task sets its own bits; only pieces of bit arrays leave it, never a row per hash."""
        piece = min(cls.PIECE, bits // 8)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                for at in (h, h >> np.uint64(32)):
                    at = at & np.uint64(bits - 1)
                    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            for i, body in enumerate(own.reshape(-1, piece)):
                if body.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), binary([body.tobytes()])], names=["piece", "body"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for same in groups(batches, 1):
                body = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in same["body"].to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([same["piece"][0].as_py()], pa.int64()), binary([body.tobytes()])], names=["piece", "body"])
        schema = "piece long, body binary"
        parts = df.select(column).mapInArrow(mark, schema)
        found = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(join, schema).toArrow()  # at most `bits` bits
        words = np.zeros(bits // 8, np.uint8)
        for i, body in zip(found["piece"].to_pylist(), found["body"].to_pylist(), strict=True):
            words[i * piece:(i + 1) * piece] = np.frombuffer(body, np.uint8)
        return cls(words.view(np.uint64), bits)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        at = at & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        own = hashes.view(np.uint64)
        return self._bit(own) & self._bit(own >> np.uint64(32))
