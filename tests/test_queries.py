"""Registered queries next to their DuckDB twins at the smallest scale, a few per family; the
whole set runs with tests/oracle_check.py."""

import pytest

from tests.conftest import SMALL
from tests.oracle_check import compare, connect

NAMES = ["flagship_recent_form", "w01_rolling_form", "w06_calendar_congestion", "w08_squad_continuity", "j01_asof_strict",
         "j02_head_to_head_asof", "j04_interval_join_values", "j05_lookback_all_competitions", "a04_player_to_team_fixture",
         "a20_gameweek_status", "p17_season_start_fixup", "f17_low_score_correction", "o01_league_table",
         "u03_dedupe_keep_first", "q05_stale_history", "m01_class_metrics", "m05_accuracy_bootstrap", "m12_decile_table",
         "d07_bet_simulation", "v08_append_only_if_different", "g03_last_trigger_and_end", "r01_elo", "s04_detailed_stats_map",
         "s09_latest_usable_snapshot", "t04_late_emissions", "t05_sliding_counts"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    from kickline.queries import ORACLE, QUERIES
    ok, message = compare(spark, con, SMALL, name, QUERIES[name], ORACLE[name])
    assert ok, message


@pytest.mark.parametrize("name", ["w05_head_to_head_expanding", "j01_asof_strict", "d07_bet_simulation", "m09_one_vs_rest_auc"])
def test_matches_duckdb_with_hot_keys(tiny_blocks, con, name):
    from kickline.queries import ORACLE, QUERIES
    ok, message = compare(tiny_blocks, con, SMALL, name, QUERIES[name], ORACLE[name])
    assert ok, message


def test_every_query_is_registered_once():
    from __spark_entry__ import entry, oracle_sql, queries
    assert callable(entry) and set(oracle_sql()) <= set(queries()) and len(queries()) > 250
