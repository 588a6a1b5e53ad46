"""The feature contract: names by rule, the version of the set and the full table layout."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAJOR = "v2"   # fixed value
SIDES = ("home", "away")

# fixed values: statistics of a team in a match
BASE_STATS = ("pts", "gf", "gc", "shots", "sot", "corners", "fouls", "cards", "xg", "xgc", "xa",
              "pts_gk", "pts_def", "pts_mid", "pts_fwd", "n_players", "saves", "save_rate")
SEASON_STATS = ("pts", "gf", "gc", "xg", "xgc", "pts_def", "pts_mid", "sot")
CONDITION_STATS = ("pts", "gf", "gc", "gd", "xg", "xgc")
CAMPAIGN = ("pts_camp", "played_camp", "ppg_camp", "gf_camp", "gc_camp", "gd_camp", "position_camp")
H2H = tuple(f"{p}_{c}" for p in ("h2h", "h2h_cond") for c in ("pts_home", "pts_away", "gf_home", "gc_home", "n"))
STATE = ("elo", "elo_delta_u3", "elo_delta_u5", "elo_delta_u10", "shots_conc_u5", "sot_conc_u5", "xg_diff_u5",
         "xgc_diff_u5", "xg_per_shot_u5", "xgc_per_shot_u5", "sot_share_u5", "sot_share_conc_u5",
         "games_7d", "games_14d", "games_21d", "streak", "surprise_u5", "surprise_u10")
COMPETITIONS = ("games_all_7d", "games_all_14d", "games_all_21d", "games_cup_7d", "games_cup_14d", "cup_games",
                "europe_games", "round_max", "days_since_last", "pts_all_u5", "gf_all_u5", "gc_all_u5")
DETAILED = ("shots_box", "shots_outside", "shots_box_conc", "shots_outside_conc", "tackles", "interceptions",
            "clearances", "blocks", "possession", "box_touches", "box_share", "box_share_conc", "pass_accuracy",
            "aerial_share")
CONTEXT_SIDE = ("n_hist", "rest_days", "promoted", "minutes_hhi")
DIFFERENTIALS = ("pts_u5", "gf_u5", "gc_u5", "xg_u5", "xgc_u5", "pts_def_u5", "pts_mid_u5", "pts_camp",
                 "position_camp", "ppg_camp", "rest_days", "n_hist", "elo", "elo_delta_u5", "streak",
                 "surprise_u10", "xg_per_shot_u5", "games_all_14d", "cup_games", "round_max", "pts_all_u5",
                 "box_share_u5", "possession_u5", "tackles_u5")

SIDE_FEATURES = (
    *[f"{s}_u{n}" for n in (3, 5) for s in BASE_STATS],
    *[f"{s}_u5_season" for s in SEASON_STATS],
    *[f"{s}_cond_u5" for s in CONDITION_STATS],
    *CAMPAIGN, "squad_continuity_u5", *STATE, *COMPETITIONS,
    *[f"{s}_u{n}" for n in (3, 5) for s in DETAILED],
    *CONTEXT_SIDE)

FEATURES = (
    *[f"{side}_{f}" for side in SIDES for f in SIDE_FEATURES], *H2H,
    "gameweek", "xg_available", "fdr_home", "fdr_away", "fdr_dif",
    *[f"dif_{d}" for d in DIFFERENTIALS])
KEYS = ("season", "fixture_id", "match_date", "kick", "home", "away")
TARGET = ("target", "home_goals", "away_goals", "goal_diff")
AUDIT = ("cutoff", "hist_kick_home", "hist_kick_away", "split", "feature_set_version", "built_at")
MARKET = ("odds_home", "odds_draw", "odds_away", "m_home", "m_draw", "m_away")
GOLD_COLUMNS = (*KEYS, *TARGET, *FEATURES, *AUDIT, *MARKET)


def feature_set_version(names: tuple[str, ...] = FEATURES) -> str:
    return f"{MAJOR}.{hashlib.sha1('|'.join(names).encode()).hexdigest()[:8]}.{len(names)}"


def version_column(names: Column) -> Column:
    """The same version string for an array column of names."""
    return F.concat(F.lit(f"{MAJOR}."), F.substring(F.sha1(F.array_join(names, "|")), 1, 8), F.lit("."),
                    F.size(names).cast("string"))


def incompatibility(model_version: str, model_features: list[str]) -> list[str]:
    """Why a model trained on another contract must not score this table; empty when it may."""
    out = []
    if model_version != feature_set_version():
        out.append(f"version {model_version} is not {feature_set_version()}")
    absent = [f for f in model_features if f not in FEATURES]
    if absent:
        out.append(f"unknown features {absent[:12]}")
    return out


def describe(spark) -> DataFrame:
    """The contract as a table: one row per Gold column with its role."""
    roles = [(c, r) for r, cols in (("key", KEYS), ("target", TARGET), ("feature", FEATURES),
                                    ("audit", AUDIT), ("market", MARKET)) for c in cols]
    return spark.createDataFrame(roles, "column_name string, role string")
