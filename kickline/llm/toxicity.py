"""Toxicity classifier, regularised by counterfactuals.

A logistic regression on the words a text holds and on their first PREFIX letters, which inflected
forms share (hashed, each counted once). Names of groups of people are a feature as a whole only, so
nothing else of a text changes with them. For every labelled text
that names a group of people the name is swapped for the others of its kind, and the squared change
of the logit is added to the loss: which group is named must not move the score. The fit uses
a sample of bounded size; all texts are scored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kickline.llm.common import batched, table, texts_of
from kickline.llm.registry import query

#: Kinds of group names; a name is swapped for the others of its line.
IDENTITY = (
    "women men", "woman man", "girls boys", "black white asian latino", "blacks whites asians latinos",
    "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual transgender", "gays lesbians", "immigrants refugees foreigners citizens",
    "american mexican chinese african european indian arab russian", "old young", "disabled blind deaf", "rich poor")
NAMES = frozenset(name.encode() for line in IDENTITY for name in line.split())
#: Labelled rows of the fit, at most; chosen by a hash of their id.
FIT_ROWS = 20_000
BUCKETS = 1 << 18
#: Labelled texts a word must be in.
LEAST_TEXTS = 5
#: First letters of a word that are a feature of their own.
PREFIX = 4
#: Weight of the swap penalty and of the squared weights; steps of the fit.
SWAP, RIDGE, STEPS = 1.0, 5e-4, 100
_OWNS = ("'s".encode(), "\u2019s".encode())
_EDGES = b".,!?;:\"'()[]{}*#$%&<>|-_/\\"


class Buckets(dict):
    """Word -> buckets of the word without the punctuation around it and of its first letters; remembers at most `most`.

    A group name, also with 's, has the bucket of the name alone.
    """

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(_EDGES)
        for ending in _OWNS:
            if bare.endswith(ending) and bare[:-len(ending)] in NAMES:
                bare = bare[:-len(ending)]
        value = ()
        if bare:
            letters = bare.decode()
            value = (bucket_of(bare),)
            if len(letters) > PREFIX and bare not in NAMES:
                value += (bucket_of(letters[:PREFIX].encode() + b"*"),)
        self[word] = value
        return value


def bucket_of(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % BUCKETS


_buckets = Buckets()


def buckets(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of the words of a text; A-Z count as lower case."""
    found = set(itertools.chain.from_iterable(map(_buckets.__getitem__, set(text.lower().split()))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def swaps(features: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(bucket of a name, bucket of another name of its kind, texts in which the one gives way to the other).

    In texts that hold both already, the name goes and no bucket comes: -1.
    """
    flat, row = np.concatenate(features), np.repeat(np.arange(len(features)), [len(x) for x in features])
    named = np.isin(flat, [bucket_of(w) for w in NAMES])
    flat, row = flat[named], row[named]
    for line in IDENTITY:
        kind = [bucket_of(w.encode()) for w in line.split()]
        held = np.stack([np.bincount(row[flat == x], minlength=len(features)) for x in kind], 1)
        both = held.T @ held
        for i, j in itertools.permutations(range(len(kind)), 2):
            yield kind[i], kind[j], int(both[i, i] - both[i, j])
            yield kind[i], -1, int(both[i, j])


def fit(features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the intercept. Without both labels all weights are zero."""
    weights = np.zeros(BUCKETS)
    if not len(labels) or labels.min() == labels.max():
        return weights, 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
    sizes = np.array([len(x) for x in features])
    flat = np.concatenate(features)
    spread = np.bincount(flat, minlength=BUCKETS)
    known = np.flatnonzero(spread >= min(LEAST_TEXTS, max(2, len(labels) // 50)))
    at = np.full(BUCKETS, -1, np.int64)
    at[known] = np.arange(len(known))
    row, col = np.repeat(np.arange(len(labels)), sizes), at[flat]
    row, col = row[col >= 0], col[col >= 0]
    # a feature counts by how much its odds differ between the labels; both labels weigh the same
    share = [(np.bincount(col[labels[row] == y], minlength=len(known)) + 1) / ((labels == y).sum() + 2) for y in (1, 0)]
    scale = np.append(np.abs(np.log(share[0] / share[1])), 1.0)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    # one term for every labelled text and swap of a name it holds
    pairs = [(at[a], at[b] if b >= 0 else -1, n) for a, b, n in swaps(features) if n and at[a] >= 0]
    a, b, n = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
    w, bias = np.zeros(len(known) + 1), 0.0  # the last stays 0: unseen names
    value = scale[col]
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col] * value, len(labels)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        slope = np.bincount(col, error[row] * value, len(w)) + 2 * RIDGE * w
        if len(a):
            change = 2 * SWAP * n * (w[a] * scale[a] - w[b] * scale[b]) / len(labels)
            slope += np.bincount(a, change * scale[a], len(w)) - np.bincount(np.where(b < 0, len(w) - 1, b), change * scale[b], len(w))
        slope[-1] = 0
        grad = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
        w, bias = w - move[:-1], bias - move[-1]
    weights[known] = (w * scale)[:-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """A fit on at most FIT_ROWS labelled rows for which `usable` (over the labels) holds."""
    chosen = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_label"))
              .orderBy(F.xxhash64(key), key).limit(FIT_ROWS))
    rows = docs.select(F.col(key).alias(key), text).join(F.broadcast(chosen), key)  # at most FIT_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([buckets(x).tobytes() for x in texts_of(batch.column(1))], pa.binary())],
                                             names=[key, "label", "x"])
    found = rows.select(key, text, "_label").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, label int, x binary").dropDuplicates([key]).toArrow()
    order = np.argsort(found[key].to_numpy(), kind="stable")
    return fit([np.frombuffer(found["x"][int(i)].as_py(), np.int32) for i in order], found["label"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """All columns of `docs` but `text`, and _score from 0 to 1.

    A null or empty text scores by the intercept alone. Every row comes back, repeated rows too; an
    empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != text]
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            z = np.array([weights[buckets(x)].sum() for x in texts_of(batch.column(len(rest)))]) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*rest, "_score"])
    return docs.select(*rest, text).mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in docs.select(*rest).dtypes], "_score double"]))


def held_out(key: str = "doc_id") -> Column:
    """Rows no fit may see: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
