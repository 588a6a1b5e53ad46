"""As-of, windows and intervals: hand-worked frames, then seeded random data against brute force
with and without the hot-key split."""

import random

import pytest
from pyspark.sql import functions as F

from kickline.operators import intervals
from kickline.operators.asof import History, asof_attach
from kickline.operators.joins import CardinalityError, checked_join, opponent_value
from kickline.operators.windows import DAY_US, lag_diff, rolling_mean, running, trailing_day_counts

DAY = DAY_US


def day(n):
    return n * DAY


def form(spark, rows):
    return spark.createDataFrame(rows, "season string, team string, t long, pts long")


def at_cutoff(spark, games, cutoffs, by=("team",), n=5):
    hist = rolling_mean(games, list(by), ["t", "pts"], {"u": ("pts", n)})
    obj = spark.createDataFrame(cutoffs, "id int, season string, team string, cutoff long")
    out = asof_attach(obj, list(by), "cutoff", [History(hist, "t", ["u"])])
    return {r.id: r.u for r in out.collect()}


def test_mean_of_what_came_before(spark):
    games = form(spark, [("S", "A", day(1), 3), ("S", "A", day(8), 0), ("S", "A", day(15), 3)])
    assert at_cutoff(spark, games, [(1, "S", "A", day(15))], n=3) == {1: 1.5}


def test_equal_instant_is_not_before(spark):
    games = form(spark, [("S", "A", day(1), 3), ("S", "A", day(8), 0)])
    assert at_cutoff(spark, games, [(1, "S", "A", day(8))]) == {1: 3.0}


def test_double_gameweek_shares_one_vector(spark):
    games = form(spark, [("S", "A", day(1), 3), ("S", "A", day(8), 0), ("S", "A", day(16), 3), ("S", "A", day(19), 1)])
    got = at_cutoff(spark, games, [(1, "S", "A", day(16)), (2, "S", "A", day(16))])
    assert got == {1: 1.5, 2: 1.5}   # a shifted window would give 2.0 for the second


def test_season_edge(spark):
    games = form(spark, [("S1", "A", day(1), 3), ("S2", "A", day(100), 0)])
    assert at_cutoff(spark, games, [(1, "S2", "A", day(100))]) == {1: 3.0}
    assert at_cutoff(spark, games, [(1, "S2", "A", day(100))], by=("season", "team")) == {1: None}


def random_rows(seed, n=160, keys=("A", "A", "A", "A", "B", "C")):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(0, 60) * DAY // 2, i, rng.choice([None, 0, 1, 3, 7])) for i in range(n)]


def ordered(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))


@pytest.fixture(params=["whole", "split"])
def sparks(request, spark):
    if request.param == "split":
        return request.getfixturevalue("tiny_blocks")
    return spark


SCHEMA = "k string, t long, id long, v long"


def test_rolling_running_and_lag_against_brute_force(sparks):
    rows = random_rows(1)
    df = sparks.createDataFrame(rows, SCHEMA)
    short = {r.id: r.m for r in rolling_mean(df, ["k"], ["t", "id"], {"m": ("v", 3)}).collect()}
    long = {r.id: r.m for r in rolling_mean(df, ["k"], ["t", "id"], {"m": ("v", 9)}).collect()}
    lag = {r.id: r.d for r in lag_diff(df, ["k"], ["t", "id"], "v", {"d": 4}).collect()}
    run = {r.id: (r.s, r.x, r.n, r.o) for r in running(df, ["k"], ["t", "id"], sums={"s": "v"}, maxima={"x": "v"}, counts={"n": "v"}, ordinal="o").collect()}
    assert len(short) == len(rows)
    for key in "ABC":
        seq = ordered(rows, key)
        for i, r in enumerate(seq):
            def mean(n):
                xs = [x[3] for x in seq[max(0, i - n + 1):i + 1] if x[3] is not None]
                return pytest.approx(sum(xs) / len(xs)) if xs else None
            assert short[r[2]] == mean(3) and long[r[2]] == mean(9)
            back = seq[i - 4][3] if i >= 4 else None
            assert lag[r[2]] == (r[3] - back if r[3] is not None and back is not None else None)
            seen = [x[3] for x in seq[:i + 1] if x[3] is not None]
            assert run[r[2]] == (sum(seen) if seen else None, max(seen) if seen else None, len(seen), i + 1)


def test_trailing_days_against_brute_force(sparks):
    rows = random_rows(2)
    df = sparks.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.d3, r.d10) for r in trailing_day_counts(df, ["k"], "t", {"d3": 3, "d10": 10}).collect()}
    for k, t, i, _ in rows:
        want = tuple(sum(1 for r in rows if r[0] == k and t - n * DAY < r[1] <= t) for n in (3, 10))
        assert got[i] == want


def test_asof_with_two_histories_against_brute_force(sparks):
    rows, other = random_rows(3), random_rows(4, n=40)
    rng = random.Random(5)
    objectives = [(i, rng.choice("ABCD"), rng.randrange(0, 70) * DAY // 2) for i in range(60)]
    h1, h2 = sparks.createDataFrame(rows, SCHEMA), sparks.createDataFrame(other, SCHEMA)
    obj = sparks.createDataFrame(objectives, "oid int, k string, at long")
    out = asof_attach(obj, ["k"], "at", [History(h1, "t", ["id"], tie="id", used_time="used"), History(h2, "t", ["v"], tie="id", prefix="o_")])
    got = {r.oid: (r.used, r.id, r.o_v) for r in out.collect()}
    assert len(got) == len(objectives)
    for oid, k, at in objectives:
        a = [r for r in ordered(rows, k) if r[1] < at]
        b = [r for r in ordered(other, k) if r[1] < at]
        assert got[oid] == (a[-1][1] if a else None, a[-1][2] if a else None, b[-1][3] if b else None)


def test_interval_totals_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice("XXY"), i % 20, i, rng.randrange(0, 40) * 10, rng.randrange(1, 99)) for i in range(120)]
    df = spark.createDataFrame(rows, "club string, player long, id long, day long, value long")
    valid = intervals.validity(df, ["player"], "day", "id")
    instants = spark.createDataFrame([(rng.randrange(-20, 500),) for _ in range(17)], "at long")
    out = intervals.valid_at(valid, ["club"], instants, "at", "value", {"total": F.col("value")}, top_n=3)
    got = {(r.club, r["at"]): (r.total, r.n_valid, r.top3) for r in out.collect()}
    table = [r.asDict() for r in valid.collect()]
    want = {}
    for (at,) in instants.distinct().collect():
        for club in "XY":
            hit = sorted((r["value"] for r in table if r["club"] == club and r["valid_from"] <= at < r["valid_to"]), reverse=True)
            if hit:
                want[(club, at)] = (sum(hit), len(hit), sum(hit[:3]))
    assert got == want


def test_rival_values_and_join_cardinality(spark):
    df = spark.createDataFrame([(1, "A", 2.0), (1, "B", 0.5), (2, "A", 1.0)], "g int, team string, xg double")
    got = {(r.g, r.team): r.xgc for r in opponent_value(df, ["g"], "team", {"xgc": "xg"}).collect()}
    assert got == {(1, "A"): 0.5, (1, "B"): 2.0, (2, "A"): None}
    three = df.union(spark.createDataFrame([(1, "C", 9.0)], df.schema))
    with pytest.raises(Exception, match="more than two sides"):
        opponent_value(three, ["g"], "team", {"xgc": "xg"}).collect()
    with pytest.raises(CardinalityError):
        checked_join(df, df.withColumnRenamed("xg", "y").drop("team"), ["g"])
    with pytest.raises(CardinalityError):
        checked_join(df.select("g"), spark.createDataFrame([(1,)], "g int"), ["g"], keep_all=True)


def test_instants_are_ranked_over_ranges(spark):
    """Equal starts, open ends, instants on the ends, ends outside of all instants; no task holds all of them."""
    rows = [("a" if i % 3 else "b", i, (i * 37) % 50 - 5, intervals.OPEN_END_US if i % 7 == 0 else (i * 37) % 50 - 5 + i % 19, i) for i in range(300)]
    rows += [("a", 900, None, 10, 5), ("b", 901, 3, None, 5), ("b", 902, 4, 4, 5)]
    valid = spark.createDataFrame(rows, "club string, id long, valid_from long, valid_to long, value long")
    at = [*range(0, 60, 2), 0, None]
    instants = spark.createDataFrame([(x,) for x in at], "at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = intervals.valid_at(valid, ["club"], instants, "at", "value", {"total": F.col("value")}, top_n=3)
        numbered, _ = intervals._rank_by_range(instants.select(F.col("at").alias("_at")).filter("_at IS NOT NULL").distinct(), valid)
        assert sorted(tuple(r) for r in numbered.collect()) == [(x, i) for i, x in enumerate(range(0, 60, 2))]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for x in range(0, 60, 2):
        for club in "ab":
            hit = sorted((v for c, _, f, t, v in rows if c == club and f is not None and t is not None and f <= x < t), reverse=True)
            if hit:
                want[club, x] = (sum(hit), len(hit), sum(hit[:3]))
    assert {(r.club, r["at"]): (r.total, r.n_valid, r.top3) for r in out.collect()} == want
    none = intervals.valid_at(valid, ["club"], instants.limit(0), "at", "value", {"total": F.col("value")})
    assert none.count() == 0


def test_wide_windows_stay_within_what_the_jvm_compiles(spark, tmp_path):
    """A reader of the tables runs no projection as a method that HotSpot leaves to its interpreter; the means do not change."""
    from kickline.operators.windows import rolling_mean
    from kickline.session import METHOD_LIMIT
    from kickline.sources.silver import table
    cols = [f"c{i}" for i in range(14)]
    rows = [(t, i, *[None if (i + j) % 5 == 0 else i * j for j in range(14)]) for t in ("a", "b") for i in range(8)]
    spark.createDataFrame(rows, "team string, kick long, " + ", ".join(f"{c} long" for c in cols)).write.parquet(f"{tmp_path}/stats.parquet")
    was = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.set(METHOD_LIMIT, "65535")
        got = rolling_mean(table(spark, str(tmp_path), "stats"), ["team"], ["kick"], {f"{c}_u{n}": (c, n) for n in (3, 5) for c in cols}).collect()
        assert int(spark.conf.get(METHOD_LIMIT)) == 8000
    finally:
        spark.conf.set(METHOD_LIMIT, was)
    assert len(got) == 16
    for r in got:
        for j, c in enumerate(cols):
            for n in (3, 5):
                seen = [i * j for i in range(max(0, r.kick - n + 1), r.kick + 1) if (i + j) % 5]
                assert r[f"{c}_u{n}"] == (sum(seen) / len(seen) if seen else None)
