"""Histories of the team-match table and what each match may see of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickline.operators.asof import History, asof_attach
from kickline.operators.calendar import cutoff_per_gameweek, last_before
from kickline.operators.joins import sized_broadcast
from kickline.operators.reshape import widen
from kickline.operators.windows import rolling_mean, running, running_mean

ORDER = ["kick", "fixture_id"]
KEY = ["season", "fixture_id"]
# fixed values: head-to-head counters are capped at two seasons of meetings
H2H_CAP, H2H_COND_CAP = 4, 2


def ordinals(long: DataFrame) -> DataFrame:
    out = running(long.select(*KEY, "team", "kick"), ["team"], ORDER, ordinal="_o")
    return out.withColumn("k", F.col("_o") - 1).drop("_o")


def championship(long: DataFrame, split: bool = True) -> DataFrame:
    """Running totals of the season, own match included."""
    out = running(long.select(*KEY, "team", "kick", "pts", "gf", "gc"), ["season", "team"], ORDER,
                  sums={"pts_camp": "pts", "gf_camp": "gf", "gc_camp": "gc"}, ordinal="played_camp", split=split)
    return (out.drop("pts", "gf", "gc")
            .withColumns({"gd_camp": F.col("gf_camp") - F.col("gc_camp"),
                          "ppg_camp": F.col("pts_camp") / F.col("played_camp")}))


def streak(long: DataFrame) -> DataFrame:
    """Mean points of the last three matches minus the season's mean so far."""
    last3 = rolling_mean(long.select(*KEY, "team", "kick", "pts"), ["team"], ORDER, {"_u3": ("pts", 3)})
    both = running_mean(last3, ["season", "team"], ORDER, {"_season": "pts"})
    return both.withColumn("streak", F.col("_u3") - F.col("_season")).drop("_u3", "_season")


def objectives(long: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """One row per match side with the cut-off it is predicted at."""
    cut = cutoffs if cutoffs is not None else cutoff_per_gameweek(long, "kick")
    return (long.select("season", "gameweek", "fixture_id", "kick", "is_home", "team", "rival")
            .join(sized_broadcast(cut), ["season", "gameweek"]))


def head_to_head(long: DataFrame, obj: DataFrame | None = None, split: bool = True, key: list[str] = KEY,
                 instants: list[int] | None = None) -> DataFrame:
    """Means over earlier meetings of the two sides, in any condition and with the same host, one row per `key`.

    The conditional variant takes the home side's home meetings and the visitor's
    away meetings: both are the rows whose `is_home` equals that of the objective. With `instants`, all cut-offs in order, only
    the meetings that one of them shows leave the running totals.
    """
    stats = ("pts", "gf", "gc")
    base = long.select("team", "rival", "is_home", "kick", "fixture_id", *stats)
    at_home, on_road = F.col("is_home"), ~F.col("is_home")
    of = {"a": F.lit(True), "h": at_home, "v": on_road}
    # one row of a pair's history carries the totals of all its meetings and those of either condition
    sums = {f"_s_{p}_{s}": F.when(cond, F.col(s)) for p, cond in of.items() for s in stats}
    known = {f"_k_{p}_{s}": F.when(cond, F.col(s)) for p, cond in of.items() for s in stats}
    rows_of = {f"{p}_n": F.when(cond, 1) for p, cond in of.items()}
    dated = {f"_d_{p}": F.when(cond & F.col("kick").isNotNull(), 1) for p, cond in of.items()}   # undated meetings alone show nothing
    totals = running(base, ["team", "rival"], ORDER, sums=sums, counts=known | rows_of | dated, split=split)
    means = {f"{p}_{s}": F.when(F.col(f"_d_{p}") > 0, F.try_divide(F.col(f"_s_{p}_{s}"), F.col(f"_k_{p}_{s}"))) for p in of for s in stats}
    hist = totals.select("team", "rival", "kick", "fixture_id", *[m.alias(n) for n, m in means.items()],
                         *[F.when(F.col(f"_d_{p}") > 0, F.col(f"{p}_n")).alias(f"{p}_n") for p in of])
    if instants is not None:
        hist = last_before(hist, ["team", "rival"], ORDER, instants, [*means, *rows_of])
    obj = objectives(long) if obj is None else obj
    sides = asof_attach(obj.select(*key, "team", "rival", "is_home", "cutoff"), ["team", "rival"], "cutoff",
                        [History(hist, "kick", [*means, *rows_of], tie="fixture_id")], split)
    sides = sides.withColumns({f"c_{x}": F.when(at_home, F.col(f"h_{x}")).otherwise(F.col(f"v_{x}")) for x in (*stats, "n")})
    home, away = F.col("is_home"), ~F.col("is_home")

    def pick(cond, c, name):
        return F.max(F.when(cond, F.col(c))).alias(name)

    return (sides.groupBy(*key).agg(
        pick(home, "a_pts", "h2h_pts_home"), pick(away, "a_pts", "h2h_pts_away"),
        pick(home, "a_gf", "h2h_gf_home"), pick(home, "a_gc", "h2h_gc_home"), pick(home, "a_n", "h2h_n"),
        pick(home, "c_pts", "h2h_cond_pts_home"), pick(away, "c_pts", "h2h_cond_pts_away"),
        pick(home, "c_gf", "h2h_cond_gf_home"), pick(home, "c_gc", "h2h_cond_gc_home"),
        pick(home, "c_n", "h2h_cond_n"))
        .withColumns({"h2h_n": F.least(F.coalesce("h2h_n", F.lit(0)), F.lit(H2H_CAP)),
                      "h2h_cond_n": F.least(F.coalesce("h2h_cond_n", F.lit(0)), F.lit(H2H_COND_CAP))}))


def table_grid(long: DataFrame, cutoffs: DataFrame | None = None, camp: DataFrame | None = None,
               split: bool = True) -> DataFrame:
    """Totals of every team of the season at every cut-off; nothing played yet is zero."""
    cut = cutoffs if cutoffs is not None else cutoff_per_gameweek(long, "kick")
    camp = championship(long, split) if camp is None else camp
    teams = long.select("season", "team").distinct()
    grid = cut.join(teams, "season").select("season", "gameweek", "cutoff", "team")
    cols = ["pts_camp", "gd_camp", "gf_camp"]
    out = asof_attach(grid, ["season", "team"], "cutoff", [History(camp, "kick", cols, tie="fixture_id")], split)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})


def league_table(long: DataFrame, cutoffs: DataFrame | None = None, camp: DataFrame | None = None,
                 split: bool = True) -> DataFrame:
    """Rank by points, goal difference and goals; the team name breaks what is left."""
    w = Window.partitionBy("season", "cutoff").orderBy(   # one row per team of the season
        F.desc("pts_camp"), F.desc("gd_camp"), F.desc("gf_camp"), "team")
    return table_grid(long, cutoffs, camp, split).withColumn("position", F.row_number().over(w))


def recent_form(long: DataFrame, stats: list[str], n: int = 5) -> DataFrame:
    """The flagship slice: wide last-n form of both sides at the cut-off, with differentials."""
    from kickline.operators.reshape import differentials
    cols = {f"{s}_u{n}": (s, n) for s in stats}
    hist = rolling_mean(long.select("team", *ORDER, *stats), ["team"], ORDER, cols)
    seen = asof_attach(objectives(long), ["team"], "cutoff",
                       [History(hist, "kick", list(cols), tie="fixture_id", used_time="hist_kick")])
    sides = seen.withColumn("side", F.when(F.col("is_home"), "home").otherwise("away"))
    wide = widen(sides, ["season", "gameweek", "fixture_id", "cutoff"], "side", ["hist_kick", *cols])
    return differentials(wide, list(cols))
