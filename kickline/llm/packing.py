"""Best-fit packing with certified bin counts.

Documents become pieces of at most one sequence. Pieces are dealt to small partitions by hash and
each partition is packed by best-fit decreasing. Dual-feasible functions give a lower bound on the
bins any packing of the same lengths needs; a partition that meets its bound is closed. The others
hand the documents of their bins with gaps to an exchange, are dealt anew by another hash and packed
again; a rerun counts only if it needs fewer bins than the ones it replaces.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kickline.llm.common import batched, table
from kickline.llm.registry import query
from kickline.session import stage

CAPACITY = 2048
#: Pieces of one partition.
PIECES = 4096
#: Exchanges at most; the bins of the last one stay as they are.
EXCHANGES = 4
#: Characters of which the two readers of the vocabulary split words alike; others go the slower way.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ‘-”…]*")
_LONG = re.compile(r"\S{2000}")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=4)
def ranks_of(path: str, ranks: str, pattern: str):
    """The same vocabulary in the faster reader, special tokens included."""
    import base64

    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    special = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=special)


def ids_of(text: str, path: str, ranks: str | None, pattern: str | None) -> np.ndarray:
    if ranks and _PLAIN.fullmatch(text) and not _LONG.search(text):
        return ranks_of(path, ranks, pattern).encode_to_numpy(text, allowed_special="all")
    return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces_of(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None,
              capacity: int = CAPACITY, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids (array), ids_crc32 and _item, a number of its own."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext
        item = TaskContext.get().partitionId() << 40
        for batch in batched(batches, 4_000_000):
            at, piece, start, length, crc, items = [], [], [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                ids = np.append(ids_of(body or "", path, ranks, pattern), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[a:first if k == 0 else a + capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    items.append(item)
                    item += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, items)]],
                                             names=[key, "piece", "start", "length", "ids_crc32", "_item"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _item long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of a family of dual-feasible functions: no packing needs fewer bins.

    f_k rounds long items up to the bin, drops short ones and keeps those between; u_k counts how many
    k-ths of a bin an item takes. Both never let a feasible bin weigh more than one.
    """
    if not len(lengths):
        return 0
    value, count = np.unique(lengths, return_counts=True)
    best = -(-int((value * count).sum()) // capacity)
    for k in np.unique(np.concatenate([value[value <= capacity // 2], [0]])):
        long = value > capacity - k
        mid = (value >= k) & ~long
        best = max(best, int(count[long].sum()) + -(-int((value[mid] * count[mid]).sum()) // capacity))
    for k in range(1, 40):  # u_k: (k+1)x/C if whole, times 1/(k+1), else floor((k+1)x/C) / k
        whole = ((k + 1) * value) % capacity == 0
        weight = np.where(whole, value * k * (k + 1), ((k + 1) * value // capacity) * capacity * (k + 1))
        best = max(best, -(-int((weight * count).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins; ties keep the items' order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r is set if a bin with r left is open
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            own, room, made = made, capacity, made + 1
        bins[i], offsets[i] = own, capacity - room
        left = room - size
        open_at[left].append(own)
        rooms |= 1 << left
    return bins, offsets, made


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES, exchanges: int = EXCHANGES) -> DataFrame:
    """`pieces` (length and a unique _item) plus sequence_id, offset and _bound.

    _bound tells whether the piece's partition met its lower bound. Pieces of a full sequence are
    their own bins; an empty table gives an empty table; equal lengths are packed in the order of _item.
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    own = pieces.columns
    done = [pieces.filter(F.col("length") >= capacity).select(*own, (-F.col("_item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("_bound"))]
    left = pieces.filter(F.col("length") < capacity).select(*own, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    n = left.count()

    def packer(turn: int, last: bool):
        def run(key, pdf):
            pdf = pdf.sort_values("_item", ignore_index=True)
            lengths = pdf["length"].to_numpy(np.int64)
            bins, offsets, made = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            before = pdf["sequence_id"]
            if turn and before.nunique() <= made:  # the rerun saves nothing
                bins, offsets = before.to_numpy(np.int64), pdf["offset"].to_numpy(np.int64)
                made = before.nunique()
                names = bins
            else:
                names = (turn << 56) + (int(key[0]) << 24) + bins
            fill = pdf["length"].groupby(bins).transform("sum").to_numpy()
            met = made <= bound
            return pdf.assign(sequence_id=names, offset=offsets, _bound=met, _closed=met or last or fill >= capacity)
        return run

    for turn in range(exchanges + 1):
        if not n:
            break
        parts = max(1, round(n / per_partition))
        # bins move whole to the exchange, so that every rerun can fall back on them
        deal = F.col("_item") if not turn else F.col("sequence_id")
        dealt = left.withColumn("_part", F.pmod(F.xxhash64(deal, F.lit(turn)), F.lit(parts)))
        packed = stage(dealt.groupBy("_part").applyInPandas(packer(turn, turn == exchanges or (turn > 0 and parts == 1)), f"{fields}, sequence_id long, offset long, _part long, _bound boolean, _closed boolean"), "packed")
        done.append(packed.filter("_closed").select(*own, "sequence_id", "offset", "_bound"))
        left = packed.filter("NOT _closed").select(*own, "sequence_id", "offset")
        n = left.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None,
                   capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all rows of `docs` with their places: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone; repeated rows are documents of their own,
    a null key stays null. Documents longer than a sequence are cut, the first piece taking what is over.
    """
    pieces = stage(pieces_of(docs, path, ranks, pattern, capacity, text=text, key=key), "pieces")
    return pack(pieces, capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary() -> dict:
    import public_tokenizers as P
    return {"path": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), **vocabulary())
