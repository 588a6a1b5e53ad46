import random

import pytest
from pyspark.sql import functions as F

from kickline.operators import coldstart as cold
from kickline.operators import ratings as rt
from kickline.operators.blocks import ROWS_PER_BLOCK
from kickline.plans import contract as ct
from kickline.sources import landing, registry as reg
from kickline.sources.versions import TableMissing, VersionedTable

EMITTED = "season int, gameweek int, fixture_id long, kick long, model string, predicted_at long, p_away double, p_draw double, p_home double"


def test_the_last_timely_emission_governs(spark):
    rows = [(1, 1, 1, 100, "m", 50, .2, .3, .5), (1, 1, 1, 100, "m", 90, .2, .3, .5), (1, 1, 1, 100, "m", 100, .1, .3, .6),
            (1, 2, 2, 200, "m", 300, .2, .3, .5), (1, 2, 2, 200, "m", 250, .2, .3, .5)]
    e = spark.createDataFrame(rows, EMITTED)
    got = {r.gameweek: (r.predicted_at, r.pre_deadline) for r in reg.governing(e, ["season", "gameweek"]).collect()}
    assert got == {1: (90, True), 2: (250, False)}
    rep = {r.predicted_at: r.repeated for r in reg.repeats(e.filter("gameweek = 1"), ["season", "gameweek"], ["fixture_id"], ["model"]).collect()}
    assert rep == {50: False, 90: True, 100: False}
    kept = reg.append_new(e.filter("gameweek = 1"), ["season", "gameweek"], ["fixture_id"], ["model"])
    assert sorted(r.predicted_at for r in kept.collect()) == [50, 100]


def test_versions_keep_everything(spark, tmp_path):
    t = VersionedTable(spark, "t", root=str(tmp_path))
    with pytest.raises(TableMissing):
        t.read()
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(3, "z")], "id int, v string")
    assert t.write(a, "first") == 1 and t.write(b, "second") == 2
    assert t.write(a.orderBy(F.desc("id")), "again") == 1        # same content, any order
    assert sorted(r.id for r in t.read().collect()) == [1, 2]
    t.restore(2)
    assert [r.id for r in t.read().collect()] == [3]
    assert {r.version for r in t.inventory().collect()} == {1, 2}
    assert sorted(r.id for r in t.read(1).collect()) == [1, 2]


def test_snapshots(spark):
    rows = [("s", 1, [(False,)]), ("s", 2, [(True,), (True,)]), ("e", 1, []), ("n", 1, None), ("r", 1, [(True,)]), ("r", 2, [(None,)])]
    m = spark.createDataFrame(rows, "source string, stamp long, entries array<struct<rejected: boolean>>")
    assert {r.source: r.stamp for r in landing.latest_usable(m, ["source"]).collect()} == {"s": 1, "e": 1, "n": 1, "r": 2}
    assert {r.source: r.stamp for r in landing.latest_at(m, ["source"], F.lit(1)).collect()} == {"s": 1, "e": 1, "n": 1, "r": 1}


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfDiv,Home\nE0,A\xffB\nE1,\n")
    df = landing.read_csv(spark, str(tmp_path), required=["Div", "Home"])
    assert df.columns == ["Div", "Home"] and [tuple(r) for r in df.orderBy("Div").collect()] == [("E0", "AB"), ("E1", None)]
    with pytest.raises(landing.MissingColumns):
        landing.read_csv(spark, str(tmp_path), required=["Away"])
    with pytest.raises(landing.NothingLanded):
        landing.read_seasons(spark, str(tmp_path), [1, 2])


def matches(n=120, leagues=("L", "M"), seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lg = rng.choice(leagues)
        h, a = rng.sample(["A", "B", "C", "D"], 2)
        rows.append((lg, 2000 + i // 40, i * 10, i, h, a, rng.randrange(5), rng.randrange(4)))
    return rows


SCHEMA = "division string, season int, kick long, fixture_id long, home string, away string, gf long, gc long"


@pytest.mark.parametrize("which", ["elo", "pi", "poisson"])
def test_folding_in_chunks_changes_nothing(spark, which):
    df = spark.createDataFrame(matches(), SCHEMA)
    run = {"elo": lambda: rt.elo(df, ["division"]), "pi": lambda: rt.pi_ratings(df, ["division"]),
           "poisson": lambda: rt.attack_defence(df, ["division"])}[which]
    whole = sorted(map(tuple, run().collect()), key=repr)
    spark.conf.set(ROWS_PER_BLOCK, "50")
    try:
        chunks = sorted(map(tuple, run().collect()), key=repr)
    finally:
        spark.conf.unset(ROWS_PER_BLOCK)
    assert whole == chunks and len(whole) == 120


def test_elo_is_zero_sum_and_pulls_to_the_start(spark):
    df = spark.createDataFrame([("L", 1, 1, 1, "A", "B", 2, 0), ("L", 2, 2, 2, "A", "C", 1, 1)], SCHEMA)
    a, b = sorted(rt.elo(df, ["division"]).collect(), key=lambda r: r.kick)
    assert a.elo_home + a.elo_away == pytest.approx(3000) and a.elo_home > 1500
    expected = 1 / (1 + 10 ** ((1500 - (a.elo_home - (a.elo_home - 1500) * .25) - 65) / 400))
    assert b.expected_home == pytest.approx(expected)


def test_full_transfer_collapses_the_two_pi_ratings(spark):
    df = spark.createDataFrame(matches(60), SCHEMA)
    rows = rt.pi_ratings(df, ["division"], transfer=1.0).collect()
    assert all(r.home_pi_home == pytest.approx(r.home_pi_away) for r in rows)


def test_seeded_history_counts_no_match_twice(spark):
    m = spark.createDataFrame(matches(80, leagues=("E0", "E1")), SCHEMA)
    both = rt.with_history(m.filter("season = 2001 AND division = 'E0'"), m, "E0")
    assert both.count() == m.count() == both.select("fixture_id").distinct().count()


def test_promoted_and_prior(spark):
    dim = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "B"), (3, "C")], "season int, team string")
    flags = {(r.season, r.team): r.promoted for r in cold.promoted_flags(dim, "team").collect()}
    assert flags == {(1, "A"): None, (1, "B"): None, (2, "A"): False, (2, "C"): True, (3, "B"): True, (3, "C"): False}
    wide = spark.createDataFrame([(0, True, None, None, None), (4, True, None, None, 2.0), (0, False, None, None, None)],
                                 "home_n_hist int, home_promoted boolean, home_pts_u5 double, home_pts_u5_season double, dif_pts_u5 double")
    prior = spark.createDataFrame([(1.25,)], "pts double")
    rows = cold.apply_prior(wide, prior).collect()
    assert [r.home_pts_u5 for r in rows] == [1.25, None, None]
    assert all(r.home_pts_u5_season is None for r in rows) and rows[0].dif_pts_u5 is None


def test_contract(spark):
    assert len(ct.FEATURES) == 279 and len(set(ct.FEATURES)) == 279 and len(ct.GOLD_COLUMNS) == 301
    names = spark.createDataFrame([(list(ct.FEATURES),)], "n array<string>")
    assert names.select(ct.version_column(F.col("n"))).first()[0] == ct.feature_set_version()
    assert ct.incompatibility(ct.feature_set_version(), ["home_pts_u5"]) == []
    assert len(ct.incompatibility("v1.x.3", ["nope"])) == 2


def test_versions_tell_nulls_types_and_order_apart(spark):
    from kickline.sources.versions import VersionedTable
    t = VersionedTable(spark, "nulls", unique=True)
    rows = "a long, b long"
    first = t.write(spark.createDataFrame([(1, None), (None, 2)], rows), "first")
    swapped = t.write(spark.createDataFrame([(None, 1), (2, None)], rows), "swapped")
    typed = t.write(spark.createDataFrame([(1, None), (None, 2)], "a int, b int"), "typed")
    again = t.write(spark.createDataFrame([(None, 2), (1, None)], rows), "again")
    assert len({first, swapped, typed}) == 3 and again == first
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, None), (None, 2)]
    assert sorted(map(tuple, t.read(swapped).collect()), key=str) == [(2, None), (None, 1)]


def test_entry_runs_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import importlib.util as u; from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            f"s = u.spec_from_file_location('__spark_entry__', {repo!r} + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
            "print('rows', m.queries()['r01_elo'](spark, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in said.stdout, said.stderr[-800:]
