"""Detailed team statistics: nested JSON to columns, totals and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: table column <- name in the source
STATS = {
    "shots_box": "attempts_ibox", "shots_outside": "attempts_obox", "shots_box_target": "att_ibox_target",
    "shots_box_conc": "attempts_conceded_ibox", "shots_outside_conc": "attempts_conceded_obox",
    "goals_conc_box": "goals_conceded_ibox", "tackles": "total_tackle", "tackles_won": "won_tackle",
    "interceptions": "interception", "clearances": "total_clearance", "blocks": "outfielder_block",
    "shots_blocked": "blocked_scoring_att", "recoveries": "recoveries", "possession": "possession_percentage",
    "passes": "total_pass", "passes_ok": "accurate_pass", "box_touches": "touches_in_opp_box",
    "progressive_carries": "progressive_carries", "saves_detailed": "saves", "big_saves": "big_chance_saves",
    "aerial_won": "aerial_won", "aerial_lost": "aerial_lost", "offsides": "total_offside",
}

JSON_SCHEMA = "map<string, struct<data: map<string, struct<M: array<struct<name: string, value: double>>>>>>"


def parse(raw: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """One document {fixture: {data: {team id: {M: [{name, value}]}}}} to one row per fixture and
    team. Teams with an empty list yield no row; an absent statistic is NULL."""
    by_fixture = raw.select(*keep, F.explode(F.from_json(json_col, JSON_SCHEMA)).alias("fixture", "payload"))
    by_team = by_fixture.select(*keep, F.col("fixture").cast("long").alias("fixture_id"),
                                F.explode("payload.data").alias("team_key", "block"))
    named = by_team.filter(F.size("block.M") > 0).select(
        *keep, "fixture_id", F.col("team_key").cast("double").cast("long").alias("team_id"),
        F.map_from_entries(F.transform("block.M", lambda m: F.struct(m["name"], m["value"]))).alias("m"))
    return named.select(*keep, "fixture_id", "team_id",
                        *[F.try_element_at("m", F.lit(src)).alias(c) for c, src in STATS.items()])


def ratios() -> dict[str, Column]:
    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))
    shots = zero("shots_box") + zero("shots_outside")
    conc = zero("shots_box_conc") + zero("shots_outside_conc")
    aerial = zero("aerial_won") + zero("aerial_lost")
    return {"shots_total": shots, "shots_conc_total": conc, "aerial_total": aerial,
            "box_share": F.try_divide(F.col("shots_box"), shots),
            "box_share_conc": F.try_divide(F.col("shots_box_conc"), conc),
            "pass_accuracy": F.try_divide(F.col("passes_ok"), F.col("passes")),
            "tackle_success": F.try_divide(F.col("tackles_won"), F.col("tackles")),
            "aerial_share": F.try_divide(F.col("aerial_won"), aerial)}


def derive(df: DataFrame) -> DataFrame:
    return df.withColumns(ratios())
