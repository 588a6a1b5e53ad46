"""Near-duplicate documents by HyperMinHash.

Every document's set of five-word shingles is dealt to registers; a register keeps its smallest hash
as a leading-zero count and a few mantissa bits. Equal sets are one node from then on. Bands of
registers are the candidate search: there an empty register borrows from one that a fixed sequence of
tries finds occupied, so every band has four samples of the set, however short the text. Sets of few shingles
search by their smallest shingles, which cannot miss a link. A band's members are paired with the band's smallest document only, the hub:
pairs whose collision-corrected estimate reaches the threshold less five deviations are confirmed
on the full sets. What is still apart from its hub is then held against the other members of the
hub, block by block and again by estimate first and full sets after, so no link is lost and no
group is expanded into pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kickline.llm.common import Bitmap, Rolling, WordValues, batched, groups, mixed, signed, table, texts_of
from kickline.llm.graph import components
from kickline.llm.registry import query
from kickline.session import stage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets up to this size search by their smallest shingles. Larger sets use bands, and so do the sizes that can be linked with one.
SMALL = 28
#: Pairs with so few registers in use are always confirmed on their sets.
FEW = 32
#: Tries of an empty register to borrow: with 22 shingles all fail with a chance of about 1e-7.
TRIES = 128
_BORROW = np.random.default_rng(20).integers(0, REGISTERS, (TRIES, REGISTERS))
#: Deviations by which an estimate may fall short and the pair is still confirmed.
SLACK = 5.0
#: Members of one block of a hub.
BLOCK = 1024
#: Bytes of sketches handled together; the arrays made from them take several times as much.
SKETCHES = 1_000_000
#: Bits of the largest set of nodes whose full sets are wanted.
MARKS = 1 << 26

_words, _rolling = WordValues(), Rolling(0xE7037ED1A0B428DB)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(SHINGLE, len(words))
    found = _rolling.windows(_words.of(words), width)
    return np.unique(found) if width == SHINGLE else mixed(found ^ np.uint64(width))


def registers(hashes: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of the smallest hash of every register as 16 bits; 0 is an empty register."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    place = mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    np.minimum.at(out, (place % np.uint64(REGISTERS)).astype(np.int64), mixed(place ^ hashes))
    fraction, length = np.frexp((out >> np.uint64(11)).astype(np.float64))
    packed = ((53 - length) << MANTISSA) + np.maximum((fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64) + 1
    return np.where(out == np.iinfo(np.uint64).max, 0, packed).astype(np.uint16)


def filled(regs: np.ndarray) -> np.ndarray:
    """Rows of registers whose empty ones hold the first occupied register of their tries; two sets try in the same order."""
    out = regs.copy()
    row, at = np.nonzero(regs == 0)
    for tries in _BORROW:
        if not len(row):
            break
        found = regs[row, tries[at]]
        out[row, at] = found
        row, at = row[found == 0], at[found == 0]
    return out


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the expected share of chance collisions."""
    used = (a != 0) | (b != 0)
    share = ((a == b) & used).sum(-1) / np.maximum(used.sum(-1), 1)
    n, m = np.asarray(n, float), np.asarray(m, float)
    chance = 0.169919 * 2.0 ** -MANTISSA * 4 * n * m / (n + m) ** 2
    return (share - chance) / (1 - chance)


def bounds(used: np.ndarray, percent: int) -> np.ndarray:
    """The estimate from which a pair is confirmed, by the number of registers in use."""
    t = percent / 100
    return np.where(used <= FEW, 0.0, t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, k1, k2 (the set's identity), n and regs of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            k1, k2, n, regs = [], [], [], []
            for body in texts_of(batch.column(1)):
                own = shingles(body)
                name = xxhash.xxh3_128_digest(own.tobytes())
                k1.append(int.from_bytes(name[:8], "little", signed=True))
                k2.append(int.from_bytes(name[8:], "little", signed=True))
                n.append(len(own))
                regs.append(registers(own).tobytes() + (own[:len(own) - -(-len(own) * PERCENT // 100) + 1].tobytes() if 0 < len(own) <= SMALL else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())],
                                             names=[key, "k1", "k2", "n", "regs"])
    return docs.select(key, text).mapInArrow(run, f"`{key}` long, k1 long, k2 long, n long, regs binary")


def band_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """(band, node): one row per band of a set that can be linked with a large one, and per small shingle of a small set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, SKETCHES):
            bodies = batch.column(1).to_pylist()
            if not bodies:
                continue
            wide = np.flatnonzero(100 * batch.column(2).to_numpy() > percent * SMALL)
            keys = np.ascontiguousarray(filled(_matrix([bodies[i] for i in wide.tolist()]))).view(np.uint64)
            found = mixed(mixed(keys) + np.arange(BANDS, dtype=np.uint64))
            extra = [np.frombuffer(x[2 * REGISTERS:], np.uint64) for x in bodies]
            rows = np.concatenate([np.repeat(wide, BANDS), np.repeat(np.arange(len(bodies)), [len(x) for x in extra])])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([found.ravel(), *[mixed(x) for x in extra]]))), batch.column(0).take(pa.array(rows))], names=["band", "node"])
    return nodes.select("node", "regs", "n").mapInArrow(run, "band long, node long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(x[:2 * REGISTERS] for x in column), np.uint16).reshape(-1, REGISTERS)


def near_hubs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (node, hub) pairs whose estimate is not too low, with the estimate."""
    full = (pairs.join(nodes.select("node", "n", "regs"), "node")
            .join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("regs").alias("other")), "hub")
            .select("node", "hub", "n", "m", "regs", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, SKETCHES):
            if batch.num_rows:
                a, b = _matrix(batch.column(4).to_pylist()), _matrix(batch.column(5).to_pylist())
                got = estimates(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy())
                good = got >= bounds(((a != 0) | (b != 0)).sum(-1), percent)
                yield pa.RecordBatch.from_arrays([*[c.filter(pa.array(good)) for c in batch.columns[:2]], pa.array(got[good])], names=["node", "hub", "est"])
    return full.mapInArrow(run, "node long, hub long, est double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (node, hub) pairs linked on their full sets, as edges (a, b)."""
    full = (pairs.select("node", "hub").join(sets.select("node", "shingles"), "node")
            .join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")), "hub").select("node", "hub", "shingles", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
    return full.mapInArrow(run, "a long, b long")


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


CELL = ["hub", "i", "j"]


def sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    mine = cell["mine"].to_numpy()
    return np.flatnonzero(mine == cell["i"][0].as_py()), np.flatnonzero(mine == cell["j"][0].as_py())


def by_cell(rows: DataFrame, run, schema: str) -> DataFrame:
    """`run` on the rows of every cell; a task holds one cell, of at most two blocks, at a time."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, len(CELL)):
            yield from run(cell).to_batches()
    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(each, schema)


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows of (hub, node, root) dealt to cells of two blocks each, so that any two members of a hub meet once or more."""
    count = members.groupBy("hub").agg(F.count("*").alias("size"), F.countDistinct("root").alias("roots")).filter("roots > 1")
    cut = members.join(count, "hub").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = cut.withColumn("other", other)
    return cells.select("hub", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("mine"))


def active_members(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(hub, node, root) of the members that may be linked with a member of the same hub in another component."""
    full = in_blocks(members).join(nodes.select("node", "n", "regs"), "node").select(*CELL, "node", "root", "mine", "n", "regs")

    def run(cell: pa.Table) -> pa.Table:
        regs, n, root = _matrix(cell["regs"].to_pylist()), cell["n"].to_numpy(), cell["root"].to_numpy()
        first, second = sides(cell)
        hit = np.zeros(len(n), bool)
        for i in first:
            rest = second[(root[second] != root[i]) & (100 * np.minimum(n[second], n[i]) >= percent * np.maximum(n[second], n[i]))]
            if len(rest):
                a = regs[i][None, :]
                got = estimates(a, regs[rest], n[i], n[rest]) >= bounds(((a != 0) | (regs[rest] != 0)).sum(-1), percent)
                hit[rest[got]] = True
                hit[i] |= bool(got.any())
        return cell.select(["hub", "node", "root"]).filter(pa.array(hit))
    return by_cell(full, run, "hub long, node long, root long").distinct()


def linked_members(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between members of a hub in different components, confirmed on full sets; enough of them to connect all that is linked."""
    full = in_blocks(members).join(sets.select("node", "shingles"), "node").select(*CELL, "node", "root", "mine", "shingles")

    def run(cell: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]
        sizes, root, node = np.array([len(x) for x in own]), cell["root"].to_numpy(), cell["node"].to_numpy()
        known, codes = np.unique(np.concatenate(own), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        first, second = sides(cell)
        name = {r: r for r in root.tolist()}  # components joined so far in this cell

        def top(r):
            while name[r] != r:
                r = name[r]
            return r
        edges: list[tuple[int, int]] = []
        has = np.zeros(len(known) + 1, np.int64)
        for i in first:
            mine = top(int(root[i]))
            tops = np.array([top(int(r)) for r in root[second]])
            rest = second[(tops != mine) & (100 * np.minimum(sizes[second], sizes[i]) >= percent * np.maximum(sizes[second], sizes[i]))]
            if not len(rest):
                continue
            has[codes[starts[i]:starts[i + 1]]] = 1
            for k in rest:
                if top(int(root[k])) != top(int(root[i])):
                    if linked(int(has[codes[starts[k]:starts[k + 1]]].sum()), int(sizes[i]), int(sizes[k]), percent):
                        edges.append((node[i], node[k]))
                        name[top(int(root[k]))] = top(int(root[i]))
            has[codes[starts[i]:starts[i + 1]]] = 0
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})
    return by_cell(full, run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id and kept, one row per row of `docs`.

    Rows whose shingle sets satisfy 100 * common >= percent * union are linked; component_id is the
    smallest key reachable, kept tells whether it is the row's own. Rows that share a key are one
    document with several texts. A row without words has an empty set and no link; so has a row with a
    null key, which is kept. An empty table gives an empty table. `key` is a whole number.
    """
    rows = stage(sketches(docs.select(F.col(key).cast("long").alias(key), text), key, text), "sketches")
    known = rows.filter(F.col(key).isNotNull() & (F.col("n") > 0))
    nodes = stage(known.groupBy("k1", "k2").agg(F.min(F.struct(F.col(key).alias("node"), "n", "regs")).alias("x")).select("k1", "k2", "x.*"), "nodes")
    bands = band_rows(nodes, percent)
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("hi")).filter("hub < hi").drop("hi")
    members = stage(bands.join(hubs, "band").filter("node <> hub").select("node", "hub").distinct(), "members")
    near = stage(near_hubs(members, nodes, percent), "near")

    source = docs.select(F.col(key).cast("long").alias("node"), text).filter("node IS NOT NULL").withColumn("h", F.xxhash64("node"))

    def sets_of(wanted: Bitmap, but: Bitmap | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batched(batches):
                h = batch.column(2).to_numpy()
                part = batch.filter(pa.array(wanted.has(h) & ~but.has(h) if but else wanted.has(h)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x).tobytes() for x in texts_of(part.column(1))], pa.binary())], names=["node", "shingles"])
        return stage(source.mapInArrow(run, "node long, shingles binary"), "sets")

    def marks(df: DataFrame) -> Bitmap:
        return Bitmap.of(df.select(F.xxhash64("node").alias("h")), "h", Bitmap.bits_for(df.count(), most=MARKS))

    paired = marks(near.select("node").unionByName(near.select(F.col("hub").alias("node"))))
    sets = sets_of(paired, None)

    # rows that share a key belong together
    several = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key)
    same = (known.join(several, key).join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col(key).alias("a"), F.col("node").alias("b")))

    best = near.groupBy("node").agg(F.max_by("hub", F.struct("est", -F.col("hub"))).alias("hub"))
    links = stage(confirmed(best, sets, percent).unionByName(same), "links")
    roots = stage(components(links), "roots")

    def rooted(df: DataFrame, name: str, to: str, roots: DataFrame) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(name), F.col("root").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))

    open_pairs = rooted(rooted(near, "node", "x", roots), "hub", "y", roots).filter("x <> y").select("node", "hub")
    links = stage(confirmed(open_pairs, sets, percent).unionByName(links), "links")
    roots = stage(components(links), "roots")

    own = members.unionByName(members.select("hub").distinct().select(F.col("hub").alias("node"), "hub"))
    left = rooted(own, "node", "root", roots)
    active = stage(active_members(left, nodes, percent), "active")
    sets = sets.unionByName(sets_of(marks(active), paired))
    links = stage(linked_members(active, sets, percent).unionByName(links), "links")
    roots = components(links)

    named = rooted(nodes.select("k1", "k2", "node"), "node", "component", roots).select("k1", "k2", "component")
    found = rows.join(named, ["k1", "k2"], "left")
    linked_rows = F.when(F.col(key).isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col(key))
    return (found.select(key, F.col("n").alias("n_shingles"), linked_rows.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


@query("op10_near_dedup")
def op10_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
