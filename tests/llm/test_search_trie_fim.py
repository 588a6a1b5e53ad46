"""Tiled top-k, prefix trie and fill-in-middle against plain versions, and nulls, empty tables, ties, repeated rows, clashing names."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL

SPACE = " \t\n\x0b\f\r"


# -- 11 tiled top-k -------------------------------------------------------------------------------------

def plain_top_k(rows, k, of):
    kept = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v in kept:
        if i % of == 0:
            met = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(met)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]  # ties beyond k
    rows += [rows[0], rows[0], (0, rows[7][1]), (None, rows[0][1]), (500, None), (510, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (540, [0.0] * 6), (550, []), (560, [1.0, 2.0]), (570, [1.5, -2.0]), (-10, rows[3][1])]
    return rows


@pytest.mark.parametrize(("shard", "asked", "fan_in"), [(10_000, 10_000, 32), (30, 7, 2)])
def test_top_k_is_exact(spark, shard, asked, fan_in):
    from pyspark.sql import functions as F
    from kickline.llm.topk import top_k
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("x") for c in ("id", "v", "q", "at", "rank", "score", "a.b", "g")})
    got = top_k(df, F.col("vec_id") % 10 == 0, 7, shard=shard, asked=asked, fan_in=fan_in)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows, 7, 10)


def test_top_k_of_large_numbers_few_and_no_rows(spark):
    from pyspark.sql import functions as F
    from kickline.llm.topk import top_k
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e12, 3.0]), (1, [1e12, 5.0]), (2, [1e12, 5.0]), (3, [-1e3, 7.0]), (4, [2.0, -9.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0, 9).collect()))
    top = (1 << 63) - 1
    assert got == [(0, r, i, max(min(s, top), -top - 1)) for _, r, i, s in plain_top_k(rows, 9, 5)]
    near = [(i, [6e5 + i % 3, 1.0]) for i in range(12)]  # sums above 2**53 that still fit
    assert sorted(map(tuple, top_k(spark.createDataFrame(near, schema), F.col("vec_id") % 4 == 0, 3, shard=5).collect())) == plain_top_k(near, 3, 4)
    none = spark.createDataFrame([], schema)
    assert top_k(none, F.col("vec_id") == 0, 3).collect() == [] and top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 77, 3).count() == 0
    assert top_k(spark.createDataFrame(rows[:1], schema), F.col("vec_id") == 0, 3).count() == 0


# -- 12 prefix trie -------------------------------------------------------------------------------------

def plain_trie(rows, tie):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, *tie[role or "", text or ""]), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ended[tuple(whole)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in kids[p])
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ended[p])).encode()).hexdigest()) for p in members)


def talks():
    r = np.random.default_rng(3)
    rows = []
    for c in range(-25, 130):
        if c == 40:
            continue  # a group without its first conversation
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(r.choice(["one", "two"], r.integers(1, 3)))) for t in range(int(r.integers(1, 6)))]
    rows += [(200, t, "user", f"long talk {t % 3}") for t in range(300)]  # a third of all rows
    rows += [(201, t, "user", f"long talk {t % 3}") for t in range(120)]
    rows += [(300 + i, 0, "user", "the same first turn") for i in range(60)] + [(300 + i, 1, "user", f"and then {i}") for i in range(0, 60, 2)]
    rows += [(400, None, None, None), (400, None, "user", "no turn"), (400, 1, "user", " x y\x0bz"), (400, 1, "user", "a tie"), (400, 1, "user", "a tie"), (None, 1, "user", "nobody"), (401, 5, "", "")]
    return rows


def hashes_of(spark, rows):
    from pyspark.sql import functions as F
    pairs = sorted({(role or "", text or "") for _, _, role, text in rows})
    df = spark.createDataFrame(pairs, "role string, text string").select("*", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "role", "text").alias("b"))
    return {(x.role, x.text): (x.a, x.b) for x in df.collect()}


def test_trie_against_plain(spark, monkeypatch):
    from pyspark.sql import functions as F
    from kickline.llm import prefix_trie
    monkeypatch.setattr(prefix_trie, "HOT_LEAST", 5)  # some parents are looked up apart
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumns({c: F.lit("x") for c in ("c", "depth", "p1", "part", "n", "a.b", "head")})
    got = prefix_trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda x: (x[0], x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_trie(rows, hashes_of(spark, rows)), key=key)


def test_trie_of_nothing_and_of_turnless(spark):
    from kickline.llm.prefix_trie import conversation_trie
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    (root,) = conversation_trie(spark.createDataFrame([(c, 0, "user", "gone")], schema)).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_contraction_of_random_trees(spark):
    from kickline.llm.prefix_trie import subtree_sums
    r = np.random.default_rng(4)
    parent, depth = {0: None}, {0: 0}
    for i in range(1, 400):
        parent[i] = i - 1 if r.random() < 0.7 else int(r.integers(0, i))  # long chains with branches
        depth[i] = depth[parent[i]] + 1
    weight = {i: int(r.integers(0, 100)) for i in parent}
    sums = dict(weight)
    for i in sorted(parent, key=depth.get, reverse=True):
        if i:
            sums[parent[i]] += sums[i]
    tree = spark.createDataFrame([(i, depth[i], parent[i], weight[i]) for i in parent], "conv long, depth long, pconv long, w long")
    assert {x.conv: x.w for x in subtree_sums(tree, ["w"]).collect()} == sums


# -- 13 fill-in-middle ----------------------------------------------------------------------------------

def plain_fim(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    units = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = np.random.default_rng(5)
    alphabet = ["a", "é", "😀", " ", "\n", "\t", " ", "<", ">", "P", "S", "M", "\x00", "\x0b", "\\0"]
    rows = [(i, "".join(r.choice(alphabet, r.integers(0, 40)))) for i in range(600)]
    rows += [(700 + i, t) for i, t in enumerate([None, "", " ", "\n \n", "word", "<P>", "a <M> b", "<<S", "x" * 300_000, "ab " * 200_000] * 6)]
    return rows + [(0, rows[0][1]), (None, "some words here"), (None, None), (-5, "minus five words long here")]


@pytest.mark.parametrize(("fim", "spm"), [(50, 80), (100, 50)])
def test_fill_in_middle_and_back(spark, fim, spm):
    from pyspark.sql import functions as F
    from kickline.llm.fim import fill_in_middle, restored
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("n", "form", "output", "key", "h1", "a.b")})
    out = fill_in_middle(df, fim_percent=fim, spm_percent=spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored()).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x)[:-1] for x in got), key=key) == sorted((plain_fim(*x, fim=fim, spm=spm) for x in rows), key=key)
    assert sorted(((x.doc_id, x.back) for x in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {x.form for x in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing_and_names(spark):
    from kickline.llm.fim import fill_in_middle
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([("k", "a b")], ["my.key", "my.text"])
    assert fill_in_middle(named, key="my.key", text="my.text").columns[0] == "my.key"
    with pytest.raises(ValueError, match="named"):
        fill_in_middle(named, key="n")


def test_sql_twins(spark):
    from kickline.llm.registry import ORACLE, QUERIES
    from tests.oracle_check import compare, connect
    import kickline.llm.fim, kickline.llm.prefix_trie, kickline.llm.topk  # noqa: E401, F401
    con = connect(SMALL)
    for name in ("op11_tiled_top_k", "op12_prefix_trie", "op13_fill_in_middle"):
        ok, message = compare(spark, con, SMALL, name, QUERIES[name], ORACLE[name])
        assert ok, message


# -- 10 candidate search by size class ------------------------------------------------------------------

@pytest.mark.parametrize("size", [22, 24, 28, 40, 100, 400, 3000])
def test_bands_meet_at_the_threshold_and_not_by_chance(size):
    from kickline.llm.near_dedup import BANDS, _matrix, filled, registers
    r = np.random.default_rng(size)
    common = -(-6 * size // 7)  # two sets of `size` with a similarity of 0.75 or a little more
    left, right = [], []
    for _ in range(400):
        own = r.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        left.append(registers(own[:size]).tobytes())
        right.append(registers(own[size - common:]).tobytes())
    a, b = (filled(_matrix(x)).view(np.uint64).reshape(-1, BANDS) for x in (left, right))
    assert (a == b).any(1).all()
    assert not (a == np.roll(b, 1, 0)).any()  # unrelated sets share no band
