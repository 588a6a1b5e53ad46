"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its parts fit; the parts, wherever they are cut, are
encoded in parallel tasks. Two neighbours are joined by encoding a window around the cut again: the
window starts at a word start of the left part and is widened until it reproduces the left part's
tokens before the cut and meets the right part at a common word start whose tokens it reproduces.
Splitting a text into words looks only ahead, so from a common word start on both encodings are the
same. When nothing agrees the window becomes the whole pair. Within a leaf, words between blanks or
line ends are encoded once and remembered, as no token crosses them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kickline.llm.common import batched, row_key, table
from kickline.llm.registry import query

#: Longest part, in code points, that one task encodes whole.
LEAF_CHARS = 32_768
#: First width of a join's window on each side; longer than any special token.
WINDOW = 64
MEMO = 300_000
#: Unknown words encoded in one call.
AT_ONCE = 1_000


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Words(dict):
    """Word without blank or line end -> for its tokens: ids (int32 bytes), first code points (int64 bytes) and whether a part of the word starts there (bool bytes)."""

    def __init__(self, path: str):
        self.path = path

    def of(self, distinct: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """The values of distinct words; unknown ones are encoded together, parted by blanks."""
        new = [w for w in distinct if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = distinct
        self[""] = b"", b"", b""
        new = [w for w in new if w]
        for k in range(0, len(new), AT_ONCE):
            some = new[k:k + AT_ONCE]
            part = Part.of(" ".join(some), 0, self.path)
            places = np.cumsum([0, *[len(w) + 1 for w in some]])
            cuts = np.searchsorted(part.starts, places)
            ids, heads = part.ids.tobytes(), part.heads.tobytes()
            starts = (part.starts - np.repeat(places[:-1], np.diff(cuts))).tobytes()
            for w, a, b in zip(some, cuts.tolist(), cuts[1:].tolist(), strict=False):
                self[w] = ids[4 * a:4 * b], starts[8 * a:8 * b], heads[a:b]
        found = [self[w] for w in distinct]
        for w in new:
            if len(w) > 64:
                del self[w]
        return found


@functools.lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)


@functools.lru_cache(maxsize=4)
def words_part(path: str) -> bool:
    """Whether blanks and line ends part words for good: they are dropped and never join a token."""
    model = tokenizer(path)
    probe = ["a b", "a\nb", " a", "a ", "a \n b", "ab 1", "́ a", "a ́b"]
    return all(model.encode(p, add_special_tokens=False).ids == [i for w in re.split("[ \n]", p) if w for i in model.encode(w, add_special_tokens=False).ids] for p in probe)


@functools.lru_cache(maxsize=4)
def tokens(path: str) -> pa.Array | None:
    """The tokens by id if decoding joins them by blanks, else None."""
    model = tokenizer(path)
    return pa.array([model.id_to_token(i) for i in range(model.get_vocab_size(with_added_tokens=True))], pa.string()) if model.decoder is None else None


def decode(offsets: np.ndarray, ids: np.ndarray, path: str) -> pa.Array:
    """The tokenizer's decoding of all ids of every text."""
    if tokens(path) is not None:
        return pc.binary_join(_lists(offsets, tokens(path).take(pa.array(ids))), " ")
    return pa.array([tokenizer(path).decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())


def encode_short(texts: pa.Array, path: str) -> list[pa.Array]:
    """Ids and decoded text of every text of a batch; where words part, each distinct word of the batch is looked up once."""
    if words_part(path):
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        coded = split.flatten().dictionary_encode()
        codes, found = coded.indices.to_numpy(), words(path).of(coded.dictionary.to_pylist())
        sizes = np.array([len(x[0]) // 4 for x in found], np.int64)
        flat, firsts, n = np.frombuffer(b"".join([x[0] for x in found]), np.int32), np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids, offsets = flat[np.repeat(firsts[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[edges]
    else:
        own = [np.asarray(tokenizer(path).encode(x or "", add_special_tokens=False).ids, np.int32) for x in texts.to_pylist()]
        ids, offsets = np.concatenate([np.zeros(0, np.int32), *own]), np.cumsum([0, *map(len, own)])
    return [_lists(offsets, pa.array(ids)), decode(offsets, ids, path)]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class Part:
    """Tokens of a stretch of a text: ids, first code points in the text, and whether a word starts there."""

    def __init__(self, ids, starts, heads, begin: int, end: int):
        self.ids, self.starts, self.heads, self.begin, self.end = ids, starts, heads, begin, end

    @classmethod
    def of(cls, text: str, begin: int, path: str) -> Part:
        found = tokenizer(path).encode(text, add_special_tokens=False)
        starts = np.asarray([a for a, _ in found.offsets], np.int64) + begin
        own = found.word_ids
        heads = np.asarray([k == 0 or w is None or w != own[k - 1] for k, w in enumerate(own)], bool)
        return cls(np.asarray(found.ids, np.int32), starts, heads, begin, begin + len(text))

    @classmethod
    def leaf(cls, text: str, begin: int, path: str) -> Part:
        """The same as `of`; where words part, from the words remembered."""
        if not words_part(path):
            return cls.of(text, begin, path)
        split = text.replace("\n", " ").split(" ")
        distinct = list(dict.fromkeys(split))
        known = dict(zip(distinct, words(path).of(distinct), strict=True))
        found = [known[w] for w in split]
        places = np.cumsum([0, *[len(w) + 1 for w in split[:-1]]]) + begin
        ids = np.frombuffer(b"".join([x[0] for x in found]), np.int32)
        starts = np.frombuffer(b"".join([x[1] for x in found]), np.int64) + np.repeat(places, [len(x[0]) // 4 for x in found])
        return cls(ids, starts, np.frombuffer(b"".join([x[2] for x in found]), bool), begin, begin + len(text))


def join(left: Part, right: Part, text: str, origin: int, path: str) -> Part:
    """The encoding of left + right; `text` holds the stretch from `origin` on."""
    cut, width = left.end, WINDOW
    while True:
        before = np.flatnonzero(left.heads & (left.starts <= cut - width))
        i = int(before[-1]) if len(before) else 0
        a = int(left.starts[i]) if len(before) else left.begin
        after = np.flatnonzero(right.heads & (right.starts >= cut + 2 * width))
        b = int(right.starts[after[0]]) if len(after) else right.end
        win = Part.of(text[a - origin:b - origin], a, path)
        if a == left.begin and b == right.end:
            return Part(win.ids, win.starts, win.heads, left.begin, right.end)
        # left: the same tokens up to half a window before the cut
        sure = cut - width // 2
        n = int(np.searchsorted(left.starts[i:], sure)) if a != left.begin else 0
        good = a == left.begin or (n > 0 and len(win.ids) >= n and np.array_equal(win.ids[:n], left.ids[i:i + n]) and np.array_equal(win.starts[:n], left.starts[i:i + n]))
        # right: a word start of both, from where the tokens are the same until near the window's end
        if good and b != right.end:
            near = b - width // 2
            for q in np.intersect1d(win.starts[win.heads], right.starts[right.heads]):
                if cut + WINDOW // 4 <= q < near:
                    u, v = np.searchsorted(win.starts, q), np.searchsorted(right.starts, q)
                    m = int(np.searchsorted(win.starts[u:], near))
                    if np.array_equal(win.ids[u:u + m], right.ids[v:v + m]) and np.array_equal(win.starts[u:u + m], right.starts[v:v + m]):
                        return Part(*[np.concatenate([getattr(left, c)[:i], getattr(win, c)[:u], getattr(right, c)[v:]]) for c in ("ids", "starts", "heads")],
                                    left.begin, right.end)
                    break
        elif good:
            return Part(*[np.concatenate([getattr(left, c)[:i], getattr(win, c)]) for c in ("ids", "starts", "heads")], left.begin, right.end)
        width *= 2


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves of a text of n code points, halved until none is longer than `leaf`."""
    parts = [(0, n)]
    while max(b - a for a, b in parts) > leaf:
        parts = [x for a, b in parts for x in ([(a, b)] if b - a <= leaf else [(a, (a + b) // 2), ((a + b) // 2, b)])]
    return parts


def join_tree(parts: list[Part], text: str, path: str) -> Part:
    """Neighbours are joined pair by pair, level by level."""
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], text, 0, path) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode(docs: DataFrame, path: str, text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """All columns of `docs` but `text`, plus `_ids` array<int> and `_decoded` string.

    `_ids` are the tokenizer's for the whole text without added special tokens, `_decoded` is its
    decoding of all ids. A null text counts as empty: no ids, empty decoding. Every row
    comes back once, repeated rows too; an empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != text]
    kinds = [f"`{c}` {t}" for c, t in docs.select(*rest).dtypes]
    n = len(rest)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, 4_000_000):
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *encode_short(batch.column(n), path)], names=[*rest, "_ids", "_decoded"])

    size = F.coalesce(F.char_length(text), F.lit(0))
    small = docs.filter(size <= leaf_chars).select(*rest, text).mapInArrow(short, ", ".join([*kinds, "_ids array<int>", "_decoded string"]))

    # long texts: equal ones once, one row for each leaf with its stretch of the text
    keyed = docs.filter(size > leaf_chars).select("*", *row_key(text))
    once = keyed.select("_k1", "_k2", text).dropDuplicates(["_k1", "_k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, 4_000_000):
            for k1, k2, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts = halves(len(body), leaf_chars)
                yield pa.RecordBatch.from_arrays([pa.array([k1] * len(parts), pa.int64()), pa.array([k2] * len(parts), pa.int64()),
                                                  pa.array([a for a, _ in parts], pa.int64()), pa.array([body[a:b] for a, b in parts], pa.string())],
                                                 names=["_k1", "_k2", "_at", "_part"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, 1_000_000):
            found = [Part.leaf(body, at, path) for at, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x.tobytes() for x in xs], pa.binary()) for xs in
                                              ([p.ids for p in found], [p.starts for p in found], [p.heads for p in found])]],
                                             names=["_k1", "_k2", "_at", "_part", "_i", "_s", "_h"])

    leaves = once.mapInArrow(cut, "_k1 long, _k2 long, _at long, _part string").repartition("_k1", "_at")
    encoded = leaves.mapInArrow(leaf, "_k1 long, _k2 long, _at long, _part string, _i binary, _s binary, _h binary")

    def tree(key, pdf):
        import pandas as pd
        pdf = pdf.sort_values("_at")
        body = "".join(pdf["_part"])
        parts = [Part(np.frombuffer(i, np.int32), np.frombuffer(s, np.int64), np.frombuffer(h, bool), at, at + len(x))
                 for i, s, h, at, x in zip(pdf["_i"], pdf["_s"], pdf["_h"], pdf["_at"], pdf["_part"], strict=True)]
        ids = join_tree(parts, body, path).ids
        return pd.DataFrame({"_k1": [key[0]], "_k2": [key[1]], "_ids": [ids], "_decoded": decode(np.array([0, len(ids)]), ids, path).to_pylist()})

    joined = encoded.groupBy("_k1", "_k2").applyInPandas(tree, "_k1 long, _k2 long, _ids array<int>, _decoded string")
    large = keyed.drop(text).join(joined, ["_k1", "_k2"]).select(*rest, "_ids", "_decoded")
    return small.unionByName(large)


@query("op6_bpe_encode_decode")
def op6_bpe_encode_decode(spark, sf_dir):
    import public_tokenizers
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"))
