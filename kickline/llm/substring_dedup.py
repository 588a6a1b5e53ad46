"""Substring dedup by difference-cover anchors.

Any two equal stretches of WINDOW words hold, at the same place in both, an anchor of ANCHOR words
whose position is in the cover modulo the period, whatever the two starts are. So it is enough to
hash anchors at cover positions: one that occurs in a single document cannot lie in a repeated
window. The windows around the anchors that occur in several documents are the extension: each
candidate window is hashed whole (128 bits) and the smallest doc_id of every window hash decides. No pair
of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kickline.llm.common import Bitmap, Rolling, WordValues, batched, mixed, signed, table, texts_of
from kickline.llm.registry import query
from kickline.session import stage

WINDOW = 50
#: A difference cover of the period: every residue is a difference of two members (fixed values).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text handled together and windows handed on together by a task.
TEXT, FLUSH = 2_000_000, 100_000

_words = WordValues()
_anchor, _first, _second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642F)


def _anchors(values: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover and the hashes of their anchors."""
    n = len(values) - anchor + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    at = at[at < n]
    return at, _anchor.windows(values, anchor)[at]


def anchor_rows(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(h, key) for every distinct anchor of every document that has a window."""
    anchor = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, TEXT):
            hashes, at = [], []
            for i, body in enumerate(texts_of(batch.column(1))):
                words = body.split()
                if len(words) >= window:
                    own = np.unique(_anchors(_words.of(words), anchor)[1])
                    hashes.append(own)
                    at.append(np.full(len(own), i))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hashes))), batch.column(0).take(pa.array(np.concatenate(at)))], names=["h", key])
    return docs.select(key, text).mapInArrow(run, f"h long, `{key}` {dict(docs.dtypes)[key]}")


def repeated_windows(words: list[bytes], window: int, anchor: int, seen: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the distinct windows that hold a repeated anchor in their first PERIOD words."""
    n = len(words) - window + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return none, none
    values = _words.of(words)
    where, hashes = _anchors(values, anchor)
    where = where[seen.has(hashes)]
    if not len(where):
        return none, none
    edge = np.zeros(n + PERIOD + 1, np.int64)  # an anchor at p is in the windows from p - PERIOD + 1 to p
    np.add.at(edge, np.maximum(where - PERIOD + 1, 0), 1)
    np.add.at(edge, np.minimum(where + 1, n), -1)
    mine = np.cumsum(edge[:n]) > 0
    a, once = np.unique(_first.windows(values, window)[mine], return_index=True)
    return a, _second.windows(mixed(values), window)[mine][once]


def window_rows(docs: DataFrame, key: str, text: str, window: int, seen: Bitmap) -> DataFrame:
    """(h1, h2, key) for every distinct window that holds a repeated anchor in its first PERIOD words."""
    anchor = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, TEXT):
            held, count = [], 0
            for i, body in enumerate(texts_of(batch.column(1))):
                a, b = repeated_windows(body.split(), window, anchor, seen)
                if len(a):
                    held.append((a, b, np.full(len(a), i)))
                    count += len(a)
                if held and (count >= FLUSH or i == batch.num_rows - 1):
                    h1, h2, at = (np.concatenate(x) for x in zip(*held, strict=True))
                    for s in range(0, count, FLUSH):
                        part = slice(s, s + FLUSH)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(h1[part])), pa.array(signed(h2[part])), batch.column(0).take(pa.array(at[part]))], names=["h1", "h2", key])
                    held, count = [], 0
    return docs.select(key, text).mapInArrow(run, f"h1 long, h2 long, `{key}` {dict(docs.dtypes)[key]}")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, _n_words, _n_removed and `text` as the kept words joined by one blank, one row per row of `docs`.

    A word is removed if a window of `window` consecutive words that covers it also starts in a row with
    a smaller key. Rows with the same key do not remove from each other; a row with a null key is never a source
    and keeps everything. Null, empty and short texts have no window; an empty table gives an empty table.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    keyed = docs.select(key, text, F.xxhash64(key).alias("_k"))
    known = keyed.filter(F.col(key).isNotNull())
    shared = stage(anchor_rows(known, key, text, window).groupBy("h").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
                   .filter("lo < hi").select("h"), "shared")
    seen = Bitmap.of(shared, "h", Bitmap.bits_for(shared.count()))
    windows = stage(window_rows(known, key, text, window, seen), "windows")
    sources = stage(windows.groupBy("h1", "h2").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo < hi").drop("hi"), "sources")
    repeated = Bitmap.of(sources, "h1", Bitmap.bits_for(sources.count()))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(repeated.has(batch.column(0).to_numpy())))

    # rows of one key have one list: what is bad for a key is bad in all its texts
    verdict = stage(windows.mapInArrow(often, windows.schema).join(sources, ["h1", "h2"]).filter(F.col(key) > F.col("lo"))
                    .groupBy(key).agg(F.collect_set("h1").alias("bad")), "verdict")  # a document's own windows
    marked = Bitmap.of(verdict.select(F.xxhash64(key).alias("_k")), "_k", Bitmap.bits_for(verdict.count()))

    def answer(batch, lists):
        n_words, n_removed, kept = [], [], []
        for body, bad in zip(texts_of(batch.column(1)), lists, strict=True):
            words = body.split()
            gone = 0
            if bad is not None and len(words) >= window:
                hit = np.isin(_first.windows(_words.of(words), window), np.asarray(bad, np.int64).view(np.uint64))
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                cover = np.cumsum(edge[:-1]) > 0
                gone = int(cover.sum())
                keep = [w for w, g in zip(words, cover.tolist(), strict=True) if not g]
            else:
                keep = words
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(keep).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                          names=[key, "_n_words", "_n_removed", text])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, _n_words long, _n_removed long, `{text}` string"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, TEXT):
            part = batch.filter(pa.array(~marked.has(batch.column(2).to_numpy())))
            if part.num_rows:
                yield answer(part, [None] * part.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, TEXT):
            yield batch.filter(pa.array(marked.has(batch.column(2).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, TEXT):
            yield answer(batch, batch.column(2).to_pylist())

    touched = (keyed.mapInArrow(maybe, keyed.schema).join(verdict, key, "left").select(key, text, "bad").mapInArrow(cut, schema))
    return keyed.mapInArrow(clean, schema).unionByName(touched)


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
