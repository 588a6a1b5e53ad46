"""Style match-ups: products of one side's attack and the other's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: attacking column x answering column
MATCHUPS = {
    "mu_box_home": ("home_box_share_u5", "away_box_share_conc_u5"),
    "mu_box_away": ("away_box_share_u5", "home_box_share_conc_u5"),
    "mu_possession_tackles_home": ("home_possession_u5", "away_tackles_u5"),
    "mu_possession_tackles_away": ("away_possession_u5", "home_tackles_u5"),
    "mu_passing_interceptions_home": ("home_pass_accuracy_u5", "away_interceptions_u5"),
    "mu_distance_blocks_home": ("home_shots_outside_u5", "away_blocks_u5"),
    "mu_aerial_home": ("home_box_touches_u5", "away_aerial_share_u5"),
}
ASYMMETRY = {"mu_possession_asymmetry": ("home_possession_u5", "away_possession_u5")}


def matchups(df: DataFrame, pairs: dict[str, tuple[str, str]] = MATCHUPS,
             asymmetry: dict[str, tuple[str, str]] = ASYMMETRY) -> DataFrame:
    """A missing base column leaves NULL instead of failing."""
    def have(a: str, b: str) -> bool:
        return a in df.columns and b in df.columns
    none = F.lit(None).cast("double")
    return df.select("*", *[(F.col(a) * F.col(b) if have(a, b) else none).alias(n) for n, (a, b) in pairs.items()],
                     *[(F.abs(F.col(a) - F.col(b)) if have(a, b) else none).alias(n) for n, (a, b) in asymmetry.items()])
