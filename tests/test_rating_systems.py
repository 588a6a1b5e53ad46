"""Rating systems, balanced chunks of a fold and grids walked at once."""

import random

import pytest
from pyspark.sql import functions as F

from kickline.functions.goals import deviance_term
from kickline.operators import ratings as rt
from kickline.operators.blocks import ROWS_PER_BLOCK
from kickline.operators.systems import components
from tests.test_tables_and_ratings import SCHEMA, matches


def plain_components(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root}


def test_components_of_chains_stars_and_loners(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = [*chain, *star, *some, (5000, 5000), *star[:5]]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 7000), (7001, None)], "a long, b long")
    assert {r.node: r.system for r in components(df, "a", "b").collect()} == plain_components(edges)
    assert components(df.filter("a = 5000"), "a", "b").collect() == [(5000, 5000)]
    assert components(df.limit(0), "a", "b").collect() == []


def two_systems():
    rows = matches(120, leagues=("E0", "E1"))
    north = [(lg, s, k, i, f"N{h}", f"N{a}", x, y) for lg, s, k, i, h, a, x, y in rows]
    south = [(f"S{lg}", s, k, 1000 + i, f"S{h}", f"S{a}", y, x) for lg, s, k, i, h, a, x, y in rows]
    return north, south


def test_disjoint_systems_are_walked_apart(spark):
    north, south = two_systems()
    both = rt.elo_seeded(spark.createDataFrame(north + south, SCHEMA).repartition(3))
    tasks = both.withColumn("task", F.spark_partition_id()).groupBy("system").agg(F.min("task").alias("a"), F.max("task").alias("b")).collect()
    assert {r.system for r in tasks} == {"NA", "SA"} and all(r.a == r.b for r in tasks)
    alone = {r.fixture_id: r.elo_home for rows in (north, south) for r in rt.elo_seeded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.fixture_id: r.elo_home for r in both.collect()} == alone and len(alone) == 240


def test_chunks_hold_equal_row_counts(spark):
    rng = random.Random(2)
    rows = [("L", 2000, (rng.randrange(1000) if i % 2 else 5_000_000 + rng.randrange(10**9)), i, *rng.sample("ABCD", 2), 1, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)   # half of the matches lie in a thousandth of a millionth of the time
    whole = sorted(map(tuple, rt.elo(df, ["division"]).collect()))
    spark.conf.set(ROWS_PER_BLOCK, "40")
    try:
        borders, chunks = rt.chunk_borders(df, ["division"], "kick")
        assert sorted(map(tuple, rt.elo(df, ["division"]).collect())) == whole
    finally:
        spark.conf.unset(ROWS_PER_BLOCK)
    cuts = borders.first()["_borders"]
    sizes = [0] * chunks
    for r in rows:
        sizes[sum(c < r[2] for c in cuts)] += 1
    assert chunks == 10 and max(sizes) <= 60 and min(sizes) >= 20


@pytest.mark.parametrize("which", ["pi", "attack"])
def test_grid_equals_one_fold_per_point(spark, which):
    df = spark.createDataFrame(matches(160), SCHEMA)
    train = [2000, 2001, 2002]
    if which == "pi":
        got = {(r.rate, r.transfer): (r.loss, r.n) for r in rt.pi_grid(df, ["division"], train, (0.1, 0.3), (0.5, 1.0)).collect()}
        for (x, y), (loss, n) in got.items():
            one = rt.pi_ratings(df, ["division"], x, y).filter(F.col("season").isin(train)).agg(F.avg("error"), F.count("*")).first()
            assert loss == pytest.approx(one[0], rel=1e-9) and n == one[1]
    else:
        got = {(r.k, r.edge): (r.loss, r.n) for r in rt.attack_defence_grid(df, ["division"], train, (0.02, 0.08), (0.1, 0.25)).collect()}
        for (x, y), (loss, n) in got.items():
            dev = (deviance_term(F.col("gf"), F.col("lam_home")) + deviance_term(F.col("gc"), F.col("lam_away"))) / 2
            one = rt.attack_defence(df, ["division"], train, x, y).filter(F.col("season").isin(train)).agg(F.avg(dev), F.count("*")).first()
            assert loss == pytest.approx(one[0], rel=1e-9) and n == one[1]
    assert len(got) == 4
