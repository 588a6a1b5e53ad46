"""Load and form over every competition, not only the league."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickline.operators.asof import History, asof_attach
from kickline.operators.reshape import points
from kickline.operators.windows import DAY_US, rolling_mean, running

# fixed values
DAY_WINDOWS = (7, 14, 21)
CUP_DAY_WINDOWS = (7, 14)
LEAGUE = "premier"
CUPS = ("eflcup", "facup")
EUROPE = ("champions", "europa")


def all_competition_form(games: DataFrame, order: tuple[str, str] = ("kick", "event_id"),
                         split: bool = True) -> DataFrame:
    done = games.filter("finished").withColumn("pts", points("gf", "gc"))
    return rolling_mean(done, ["team"], list(order),
                        {"pts_all_u5": ("pts", 5), "gf_all_u5": ("gf", 5), "gc_all_u5": ("gc", 5)}, split)


def competition_load(objectives: DataFrame, games: DataFrame, keys: list[str], tie: str = "event_id",
                     split: bool = True) -> DataFrame:
    """Per objective (team, season, cutoff): games in [cutoff - d, cutoff), season cup runs, days
    since the last game and last-five form, over games strictly before the cut-off.

    A count in a calendar window is the difference of two running counts, read
    as of the cut-off and as of its start; no game is paired with an objective.
    """
    order = ["kick", tie]
    hist = all_competition_form(games, (order[0], order[1]), split)
    cup = F.when(F.col("competition") != LEAGUE, 1).otherwise(0)
    hist = running(hist, ["team"], order, sums={"_cup": cup}, ordinal="_all", split=split)
    in_cup = F.col("competition").isin(*CUPS)
    in_europe = F.col("competition").isin(*EUROPE)
    season = running(hist, ["team", "season"], order,
                     sums={"cup_games": F.when(in_cup, 1).otherwise(0),
                           "europe_games": F.when(in_europe, 1).otherwise(0)},
                     maxima={"_round": F.when(F.col("competition") != LEAGUE, F.col("round_weight"))}, split=split)

    starts = (0, *DAY_WINDOWS)
    probes = objectives.select(*keys, "team", "season", "cutoff", F.explode(F.array(*[
        F.struct(F.lit(d).alias("_d"), (F.col("cutoff") - d * DAY_US).alias("_at")) for d in starts])).alias("_p"))
    probes = probes.select(*keys, "team", "season", "cutoff", "_p.*")
    form_cols = ["pts_all_u5", "gf_all_u5", "gc_all_u5"]
    seen = asof_attach(probes, ["team"], "_at",
                       [History(hist, "kick", ["_all", "_cup", *form_cols], tie=tie, used_time="_last")], split)

    def at(d: int, c: str):
        return F.max(F.when(F.col("_d") == d, F.col(c)))

    wide = seen.groupBy(*keys, "team", "season", "cutoff").agg(
        *[F.coalesce(at(d, "_all"), F.lit(0)).alias(f"_all{d}") for d in starts],
        *[F.coalesce(at(d, "_cup"), F.lit(0)).alias(f"_cup{d}") for d in (0, *CUP_DAY_WINDOWS)],
        at(0, "_last").alias("_last"), *[at(0, c).alias(c) for c in form_cols])
    wide = asof_attach(wide, ["team", "season"], "cutoff",
                       [History(season, "kick", ["cup_games", "europe_games", "_round"], tie=tie)], split)
    known = F.col("_last").isNotNull()
    return wide.select(
        *keys, *[c for c in ("team", "season", "cutoff") if c not in keys],
        *[(F.col("_all0") - F.col(f"_all{d}")).alias(f"games_all_{d}d") for d in DAY_WINDOWS],
        *[(F.col("_cup0") - F.col(f"_cup{d}")).alias(f"games_cup_{d}d") for d in CUP_DAY_WINDOWS],
        F.coalesce("cup_games", F.lit(0)).alias("cup_games"), F.coalesce("europe_games", F.lit(0)).alias("europe_games"),
        F.when(known, F.coalesce("_round", F.lit(0))).alias("round_max"),
        ((F.col("cutoff") - F.col("_last")) / DAY_US).alias("days_since_last"), *form_cols)
