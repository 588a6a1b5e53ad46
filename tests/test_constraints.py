"""The constraint suite on a season without a fault, then with one injected violation for each rule."""

import pytest

from kickline.operators.checks import QualityError
from kickline.operators.constraints import require, violations
from kickline.queries.quality import CONSTRAINTS, KEYS

TEAMS = [f"T{i:02d}" for i in range(20)]
MATCH = ("season int, fixture_id long, gameweek int, match_date date, home string, away string, result string, home_goals long, away_goals long, odds_home double, odds_draw double, "
         "odds_away double, fdr_home long, fdr_away long, w_home long, w_draw long, w_away long")
PLAYER = "season int, fixture_id long, line_no int, gameweek int, team string, player string, position string, minutes long, xg double"
CUT = "season int, gameweek int, cutoff long"


def season():
    import datetime
    day = datetime.date(2001, 1, 1)
    pairs = [(a, b) for a in TEAMS for b in TEAMS if a != b]
    match = [[1, i, i % 38 + 1, day, a, b, "home", 2, 1, 1.5, 3.0, 4.0, 1, 5, 1, 1, 1] for i, (a, b) in enumerate(pairs)]
    player = [[1, i, 1, i % 38 + 1, a, f"p{i}", "GK", 90, 0.1] for i, (a, _) in enumerate(pairs)]
    return {"match": match, "player": player, "cut": [[1, g, 5] for g in range(1, 39)], "team": [[t] for t in TEAMS]}


SCHEMAS = {"match": MATCH, "player": PLAYER, "cut": CUT, "team": "n_name string"}
NAMES = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}


def changed(rows, table, changes):
    """Changes are (row number, column, value)."""
    for at, column, value in changes:
        rows[table][at][NAMES[table].index(column)] = value


#: (table, changes, the rule they violate); every change touches a row of its own.
FAULTS = [
    ("match", [(0, "match_date", None)], "keys_present"), ("match", [(1, "result", "lost")], "result_known"), ("match", [(2, "result", "away")], "result_is_that_of_the_goals"),
    ("match", [(3, "away", "T00"), (3, "home", "T00")], "two_teams"), ("match", [(4, "odds_home", 1.0)], "odds_home_above_one"), ("match", [(5, "odds_draw", 0.5)], "odds_draw_above_one"),
    ("match", [(6, "odds_away", -1.0)], "odds_away_above_one"), ("match", [(7, "fdr_home", 0)], "fdr_home_from_1_to_5"), ("match", [(8, "fdr_away", 6)], "fdr_away_from_1_to_5"),
    ("match", [(9, "gameweek", 39)], "gameweek_in_range"), ("match", [(10, "w_draw", None)], "weights_positive"), ("match", [(11, "fixture_id", 12)], "fixture_once"),
    ("match", [(20, "home", "T05"), (20, "away", "T06")], "pair_once"), ("match", [(40, "season", 2)], "matches_of_a_season"), ("match", [(i, "odds_home", None) for i in range(50, 90)], "odds_nearly_complete"),
    ("match", [(i, "gameweek", 1) for i in range(37, 380, 38)], "gameweeks_present"), ("cut", [(0, "cutoff", None)], "cutoff_present"), ("cut", [(2, "gameweek", 2), (2, "cutoff", 9)], "one_cutoff"),
    ("player", [(0, "team", None)], "keys_present"), ("player", [(1, "position", "AM")], "position_known"), ("player", [(2, "minutes", 121)], "minutes_from_0_to_120"),
    ("player", [(i, "xg", None) for i in range(4)], "xg_nearly_complete"), ("player", [(4, "fixture_id", 5), (4, "player", "p5")], "player_once_in_a_match"),
    ("match", [(13, "home", "X")], "home_is_a_team"), ("match", [(14, "away", "Y")], "away_is_a_team"), ("player", [(6, "team", "Z")], "team_is_a_team"),
    ("player", [(7, "fixture_id", 9999)], "match_exists"), ("match", [(15, "season", 3)], "cutoff_exists"),
]


def frames(spark, rows):
    return {t: spark.createDataFrame([tuple(r) for r in own], SCHEMAS[t]) for t, own in rows.items()}


def test_nothing_is_found_in_a_season_without_a_fault(spark):
    found = violations(frames(spark, season()), KEYS, CONSTRAINTS).collect()
    assert len(found) == len(CONSTRAINTS) and all(r.violations == 0 and r["sample"] is None for r in found)
    empty = {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    assert all(r.violations == 0 for r in violations(empty, KEYS, CONSTRAINTS).collect())


def test_every_rule_finds_its_fault(spark):
    rows = season()
    assert {(t, rule) for t, _, rule in FAULTS} == {(r.table, r.name) for r in CONSTRAINTS}
    for table, changes, _ in FAULTS:
        changed(rows, table, changes)
    tables = frames(spark, rows)
    found = {(r.table_name, r.rule): (r.violations, r["sample"]) for r in violations(tables, KEYS, CONSTRAINTS).collect()}
    assert all(n > 0 and sample is not None for n, sample in found.values()), {k: v for k, v in found.items() if not v[0]}
    assert found["match", "result_known"] == (1, "1|1") and found["match", "fdr_away_from_1_to_5"] == (1, "1|8") and found["match", "home_is_a_team"] == (1, "X")
    assert found["player", "team_is_a_team"] == (2, "")   # a null, which comes first, and Z
    assert found["player", "match_exists"][0] >= 1 and found["match", "pair_once"] == (1, "1|T05|T06")
    with pytest.raises(QualityError, match="player.position_known: 1, for example 1"):
        require(tables, KEYS, CONSTRAINTS)
