"""Column names and codes of the landed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: result codes of the match source
RESULT_CODES = {"H": "home", "D": "draw", "A": "away"}

# fixed values: match source column -> table column
MATCH_COLUMNS = {
    "Date": "match_date", "Time": "kickoff_local", "HomeTeam": "fd_home", "AwayTeam": "fd_away",
    "FTHG": "home_goals", "FTAG": "away_goals", "FTR": "result",
    "HTHG": "home_goals_ht", "HTAG": "away_goals_ht", "HTR": "result_ht",
    "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_target", "AST": "away_shots_target",
    "HC": "home_corners", "AC": "away_corners", "HF": "home_fouls", "AF": "away_fouls",
    "HY": "home_yellows", "AY": "away_yellows", "HR": "home_reds", "AR": "away_reds",
    "B365H": "odds_b365_home", "B365D": "odds_b365_draw", "B365A": "odds_b365_away",
    "AvgH": "odds_avg_home", "AvgD": "odds_avg_draw", "AvgA": "odds_avg_away",
    "B365CH": "odds_b365_close_home", "B365CD": "odds_b365_close_draw", "B365CA": "odds_b365_close_away",
    "AvgCH": "odds_avg_close_home", "AvgCD": "odds_avg_close_draw", "AvgCA": "odds_avg_close_away",
    "MaxCH": "odds_max_close_home", "MaxCD": "odds_max_close_draw", "MaxCA": "odds_max_close_away",
}

# fixed values: weight of a cup round
ROUND_IMPORTANCE = {
    "1st Round": 1, "2nd Round": 2, "3rd Round": 3, "4th Round": 4, "5th Round": 5,
    "Round of 16": 6, "Quarter-Finals": 7, "Semi-Finals": 8, "Final": 9,
    "League Phase": 3, "Group Stage": 3, "Play-Offs": 5,
}


def present_only(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames and keeps the listed columns that exist."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if c in df.columns])


def recode(c: Column, table: dict) -> Column:
    """Dictionary lookup, NULL for what is not listed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def round_importance(label: Column) -> Column:
    return recode(label, ROUND_IMPORTANCE)
