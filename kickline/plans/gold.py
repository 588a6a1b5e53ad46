"""One row per match with everything known strictly before its cut-off.

Histories that share a key set are one wide table per key set, attached in one
as-of pass: by team (form, season, championship, state, detailed windows, squad,
ratings, and the two conditions), by pair of teams, and the competitions. What a team
shows is worked out and written once per cut-off, the matches without it beside; a reader joins the two. A season-bound value is the team's last row when that row is of the same season:
a team's latest match before the cut-off is its latest of the season, if any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.functions.market import implied
from kickline.operators import calendar as cal
from kickline.operators import checks as ck
from kickline.operators import coldstart as cold
from kickline.operators import ratings as rt
from kickline.operators.asof import History, asof_attach
from kickline.operators.blocks import hot_spans, same_key
from kickline.operators.calendar import last_before
from kickline.operators.joins import opponent_value, sized_broadcast
from kickline.operators.players import team_stats_by_fixture
from kickline.operators.reshape import outcome, two_sides
from kickline.operators.squad import squad_windows
from kickline.operators.systems import with_system
from kickline.operators.windows import DAY_US, lookback, rolling_mean, running, trailing_day_counts
from kickline.plans import contract as ct
from kickline.plans import form
from kickline.plans.competitions import competition_load
from kickline.plans.training_rows import HISTORY_CAP, season_start, split_label
from kickline.session import stage

KEY = ["season", "fixture_id"]
ORDER = ["kick", "fixture_id"]
FEW_VIEWS = 20_000   # rows of the wide table of views that may be broadcast
FEW_PAIRS = 300_000     # of ten numbers a row: pairs of teams and gameweeks that may be broadcast
FRAME_GAMES = 500_000   # two numbers a row: games within the frames that may be broadcast


@dataclass(frozen=True)
class Inputs:
    """Silver tables. `matches` holds scheduled fixtures too; the clock tells which were played."""

    matches: DataFrame
    long: DataFrame
    players: DataFrame
    games: DataFrame
    detailed: DataFrame


def frames(narrow: DataFrame, order: list[str], reach: list[tuple[list[str], str, int]]) -> DataFrame:
    """The rows that a frame of a shown row holds. `reach`: keys, the row's ordinal among them and how far the frames go back.

    Frames over these rows alone are the frames over all rows: a shown row has its predecessors here, and none between.
    """
    out, kept = narrow, F.lit(False)
    for i, (keys, ordinal, back) in enumerate(reach):
        held = (narrow.filter("_shown").select(*keys, F.explode(F.sequence(F.greatest(F.col(ordinal) - back, F.lit(1)), F.col(ordinal))).alias(ordinal))
                .distinct().withColumn(f"_in{i}", F.lit(True)))
        out = out.alias("d").join(sized_broadcast(held).alias("s"), same_key("d", "s", keys) & (F.col(f"d.{ordinal}") == F.col(f"s.{ordinal}")), "left").select("d.*", f"s._in{i}")
        kept = kept | F.coalesce(f"_in{i}", F.lit(False))
    return out.filter(kept | (F.col("played_camp") <= cold.FIRST_GAMES)).drop(*[f"_in{i}" for i in range(len(reach))])


def team_history(long: DataFrame, players: DataFrame, detailed: DataFrame, rated: DataFrame, cutoffs: list[int],
                 masked: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The wide rows a team shows before one of the cut-offs, own match included; the rows they are made from, with the first
    games of every season; the campaign as any cut-off shows it; and whether any team is hot.

    A cut-off shows a team's last match before it, of a season and at home or away: one row per gap between cut-offs, season and condition. Ordinals
    and totals run over all rows while these are narrow. Only the rows within a frame of a shown one then become wide.
    """
    shown = last_before(long, ["season", "team", "is_home"], ORDER, cutoffs)
    shown = stage(shown.select("season", "team", "is_home", "kick", "fixture_id", F.lit(True).alias("_shown")), "shown")
    if (long.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 2:
        raise ck.QualityError(f"a game ({', '.join(KEY)}) has more than two sides")
    narrow = long.select(*KEY, "team", "is_home", "kick", "pts", "gf", "gc")
    narrow = (narrow.alias("b").join(sized_broadcast(shown).alias("s"), same_key("b", "s", ["season", "team", "is_home", "fixture_id"]) & (F.col("b.kick") == F.col("s.kick")), "left")
              .select("b.*", F.coalesce("s._shown", F.lit(False)).alias("_shown")))
    # a season, condition or pair of a team has no more rows than the team
    split = hot_spans(long.select("team", "kick"), ["team"], "kick") is not None
    narrow = running(narrow, ["team"], ORDER, ordinal="_games", split=split)
    narrow = running(narrow, ["team", "is_home"], ORDER, ordinal="_of_condition", split=split)
    narrow = running(narrow, ["season", "team"], ORDER, sums={"pts_camp": "pts", "gf_camp": "gf", "gc_camp": "gc"}, ordinal="played_camp", split=split)
    narrow = stage(narrow.drop("pts", "gf", "gc"), "team-ordinals")
    days = trailing_day_counts(narrow.select(*KEY, "team", "is_home", "kick", "_shown"), ["team"], "kick", {f"games_{n}d": n for n in (7, 14, 21)}, split, F.col("_shown"))
    days = days.drop("kick", "_shown")
    held = stage(frames(narrow, ORDER, [(["team"], "_games", 10), (["team", "is_home"], "_of_condition", 4), (["season", "team"], "played_camp", 4)]), "team-frames")
    games = sized_broadcast(held.select(*KEY).distinct(), FRAME_GAMES)

    def of_games(df: DataFrame) -> DataFrame:
        return df.alias("d").join(games.alias("g"), same_key("d", "g", KEY), "left_semi")

    players = of_games(players)
    stats = team_stats_by_fixture(players, masked).drop("gameweek")
    # the rival's shots first, while the rows are narrow
    base = opponent_value(of_games(long), KEY, "team", {"shots_conc": "shots", "sot_conc": "sot"})
    base = base.join(stats, [*KEY, "team"], "left").join(of_games(detailed), [*KEY, "team"], "left").join(of_games(rated), [*KEY, "team"], "left")
    base = base.withColumns({
        "xg_diff": F.col("gf") - F.col("xg"), "xgc_diff": F.col("gc") - F.col("xgc"),
        "xg_per_shot": F.try_divide(F.col("xg"), F.col("shots")), "xgc_per_shot": F.try_divide(F.col("xgc"), F.col("shots_conc")),
        "sot_share": F.try_divide(F.col("sot"), F.col("shots")), "sot_share_conc": F.try_divide(F.col("sot_conc"), F.col("shots_conc"))})
    own = ["_shown", "_games", "pts_camp", "gf_camp", "gc_camp", "played_camp"]
    base = base.alias("b").join(held.alias("s"), same_key("b", "s", [*KEY, "team", "is_home"])).select("b.*", *[f"s.{c}" for c in own])
    base = stage(base, "team-base")   # read by the windows and the prior

    def slow_windows(w) -> dict[str, Column]:
        out = {f"surprise_u{n}": F.avg("surprise").over(w.rowsBetween(-(n - 1), 0)) for n in (5, 10)}
        return out | {f"elo_delta_u{n}": F.col("elo") - F.lag("elo", n).over(w) for n in (3, 5, 10)}

    ratios = ("shots_conc", "sot_conc", "xg_diff", "xgc_diff", "xg_per_shot", "xgc_per_shot", "sot_share", "sot_share_conc")
    short = {f"{s}_u{n}": (s, n) for n in (3, 5) for s in (*ct.BASE_STATS, *ct.DETAILED)} | {f"{s}_u5": (s, 5) for s in ratios}
    by_season = {f"{s}_u5_season": (s, 5) for s in ct.SEASON_STATS}
    by_condition = {f"{s}_cond_u5": (s, 5) for s in ct.CONDITION_STATS}

    marked = F.col("_shown")
    ordinal = held.select(*KEY, "team", "is_home", "_shown", (F.col("_games") - 1).alias("k"))
    squad = squad_windows(players, ordinal, split=split).filter(marked).drop("_shown", "k")

    # the windows with the fewest outputs first, so that the sorts carry little
    out = rolling_mean(base, ["team", "is_home"], ORDER, by_condition, split)
    out = rolling_mean(out, ["season", "team"], ORDER, by_season, split)
    out = lookback(out, ["team"], ORDER, 10, slow_windows, split)
    out = rolling_mean(out, ["team"], ORDER, short, split).filter(marked).drop("_shown")
    out = out.join(squad, [*KEY, "team", "is_home"], "left").join(days, [*KEY, "team", "is_home"], "left")
    campaign = {"gd_camp": F.col("gf_camp") - F.col("gc_camp"), "ppg_camp": F.col("pts_camp") / F.col("played_camp")}
    out = out.withColumns({
        "n_hist": F.least("_games", F.lit(HISTORY_CAP)), **campaign,
        "streak": F.col("pts_u3") - F.col("pts_camp") / F.col("played_camp"), "hist_season": F.col("season")})
    camp = narrow.filter(marked).withColumns(campaign).select(*KEY, "team", "kick", "pts_camp", "gf_camp", "gd_camp")
    return out.withColumnRenamed("squad_continuity", "squad_continuity_u5"), base, camp, split


def rated_sides(matches: DataFrame) -> DataFrame:
    folded = rt.elo(rt.as_matches(with_system(matches)), ["system"])
    return (rt.per_team(folded, ["system"], {"elo": ("elo_home", "elo_away"), "surprise": ("surprise", "surprise")})
            .select(*KEY, "team", "elo", "surprise"))


def build(inp: Inputs, now_us: int, current_season: int, holdout: int, train: list[int],
          masked: dict[int, int] | None = None) -> DataFrame:
    m = inp.matches
    played = F.col("kick") < now_us
    done, long = m.filter(played), inp.long.filter(played)
    cut = cal.cutoff_per_gameweek(m, "kick")

    this = m.filter(F.col("season") == current_season).select("season", "gameweek", "fixture_id", "kick")
    coming = (cal.next_predictable(cal.gameweek_status(this, played, now_us))
              .select("season", F.col("next_gameweek").alias("gameweek")))
    ahead = m.filter(~played).join(F.broadcast(coming), ["season", "gameweek"], "left_semi")   # one row
    targets = done.unionByName(ahead).join(sized_broadcast(cut), ["season", "gameweek"])
    sides = two_sides(targets, ["season", "gameweek", "fixture_id", "kick", "cutoff"], {"team": ("home", "away"), "rival": ("away", "home")})
    # all matches of a team in a gameweek see the same history
    views = sides.select("season", "gameweek", "team", "cutoff").distinct()

    instants = [r[0] for r in cut.select(F.col("cutoff").cast("long")).distinct().orderBy("cutoff").collect() if r[0] is not None]   # one per gameweek
    hist, base, camp, split = team_history(long, inp.players.filter(played), inp.detailed, rated_sides(done), instants, masked)
    by_season = [f"{s}_u5_season" for s in ct.SEASON_STATS]
    campaign = ["pts_camp", "played_camp", "ppg_camp", "gf_camp", "gc_camp", "gd_camp"]
    conditions = [f"{s}_cond_u5" for s in ct.CONDITION_STATS]
    cross = [f for f in ct.SIDE_FEATURES if f not in {*by_season, *campaign, *conditions, "position_camp", *ct.COMPETITIONS,
                                                      "rest_days", "promoted"}]
    hist = stage(hist.select("fixture_id", "team", "is_home", "kick", "hist_season", *cross, *by_season, *campaign, *conditions), "team-history")

    seen = asof_attach(views, ["team"], "cutoff", [
        History(hist, "kick", ["hist_season", *cross, *by_season, *campaign], tie="fixture_id", used_time="hist_kick"),
        History(hist.filter("is_home"), "kick", conditions, tie="fixture_id", prefix="h_"),
        History(hist.filter(~F.col("is_home")), "kick", conditions, tie="fixture_id", prefix="v_")], split)
    same = F.col("hist_season") == F.col("season")
    seen = seen.withColumns({c: F.when(same, F.col(c)) for c in (*by_season, *campaign)}).drop("hist_season")

    flags = cold.promoted_flags(m.select("season", F.explode(F.array("home", "away")).alias("team")), "team")
    table = form.league_table(long, cut, camp, split=split)
    seen = (seen.join(sized_broadcast(flags), ["season", "team"], "left")
            .join(sized_broadcast(table.select("season", "gameweek", "team", F.col("position").cast("double").alias("position_camp"))),
                  ["season", "gameweek", "team"], "left"))
    seen = season_start(seen, ["pts_camp", "played_camp", "gf_camp", "gc_camp", "gd_camp"], ["ppg_camp", "position_camp"],
                        "played_camp", n_hist="n_hist")
    load = competition_load(views, inp.games.filter(played), ["gameweek"], split=split)
    seen = stage(seen.join(load.drop("cutoff"), ["season", "gameweek", "team"], "left"), "views")
    few = seen.count() <= FEW_VIEWS

    prior_stats = [*ct.BASE_STATS, "gd"]
    prior = cold.promoted_prior(base, flags, prior_stats, train).select(*prior_stats)

    def with_side(matches: DataFrame, side: str, condition: str) -> DataFrame:
        """The view of one side of every match, under its own condition."""
        cols = [f for f in ct.SIDE_FEATURES if f not in {*conditions, "rest_days"}]
        # before the prior: a side without history keeps an unknown difference
        view = seen.select("season", "gameweek", F.col("team").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in cols],
                           *[F.col(f"{condition}_{f}").alias(f"{side}_{f}") for f in conditions], F.col("hist_kick").alias(f"hist_kick_{side}"),
                           *[F.col(d).alias(f"raw_{side}_{d}") for d in ct.DIFFERENTIALS if d != "rest_days"])
        view = cold.apply_prior(view, prior, (side,))   # on the views, which are fewer and narrower than the matches
        view = (F.broadcast(view) if few else view).alias("v")
        on = (F.col("m.season") == F.col("v.season")) & (F.col("m.gameweek") == F.col("v.gameweek")) & F.col(f"m.{side}").eqNullSafe(F.col(f"v.{side}"))
        return (matches.alias("m").join(view, on).select("m.*", *[f"v.{c}" for c in view.columns if c not in ("season", "gameweek", side)])
                .withColumn(f"{side}_rest_days", (F.col("kick") - F.col(f"hist_kick_{side}")) / DAY_US))

    # all matches of a pair in a gameweek see the same meetings
    hosts = ["season", "gameweek", "home", "away"]
    meeting = two_sides(targets.select(*hosts, "cutoff").distinct(), [*hosts, "cutoff"], {"team": ("home", "away"), "rival": ("away", "home")})
    pair = stage(form.head_to_head(long, meeting, split, hosts, instants), "pairs")
    xg = (team_stats_by_fixture(inp.players.filter(played), masked, ["xg"])
          .select(*KEY, F.col("team").alias("home"), (F.col("xg_available") & F.col("xg").isNotNull()).alias("xg_available")))
    odds = [F.col(f"odds_{c}") for c in ("home", "draw", "away")]
    known = {c: F.when(played, F.col(c)) for c in ("home_goals", "away_goals")}
    top = targets.select("season", "gameweek", "fixture_id", "match_date", "kick", "home", "away", "cutoff", "fdr_home", "fdr_away",
                         *[c.alias(n) for n, c in known.items()], *[f"odds_{c}" for c in ("home", "draw", "away")],
                         *[v.alias(f"m_{k}") for k, v in implied(*odds).items()])
    # the narrow joins are written; the wide columns are joined by the reader, with those it asks for
    top = top.filter(F.col("fixture_id").isNotNull()).join(xg, [*KEY, "home"], "left").alias("m")
    top = top.join(sized_broadcast(pair, FEW_PAIRS).alias("p"), same_key("m", "p", hosts)).select("m.*", *[f"p.{c}" for c in pair.columns if c not in hosts])
    narrow = stage(top, "gold-matches")
    gold = with_side(with_side(narrow, "home", "h"), "away", "v")
    raw = {d: ("home_rest_days", "away_rest_days") if d == "rest_days" else (f"raw_home_{d}", f"raw_away_{d}") for d in ct.DIFFERENTIALS}
    gold = gold.select("*", outcome("home_goals", "away_goals").alias("target"), (F.col("home_goals") - F.col("away_goals")).alias("goal_diff"),
                       (F.col("fdr_home") - F.col("fdr_away")).alias("fdr_dif"), *[(F.col(h) - F.col(a)).alias(f"dif_{d}") for d, (h, a) in raw.items()])
    gold = gold.withColumns({
        "xg_available": F.coalesce("xg_available", F.lit(False)), "split": split_label("target", "season", holdout, train),
        "feature_set_version": F.lit(ct.feature_set_version()), "built_at": F.lit(now_us)})
    return gold.select(*ct.GOLD_COLUMNS)


def validate(gold: DataFrame, current_season: int) -> DataFrame:
    """The gates a table passes before it is written."""
    banned = ck.banned_columns(gold)
    if banned:
        raise ck.LeakageError(f"banned columns {banned}")
    gold = ck.require_contract(gold, list(ct.GOLD_COLUMNS))
    late = (F.col("hist_kick_home") >= F.col("cutoff")) | (F.col("hist_kick_away") >= F.col("cutoff"))
    row = (gold.agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late")).crossJoin(
        ck.inference_coherence(gold, "target", "split", current_season))).first()
    if row.late:
        raise ck.LeakageError(f"{row.late} rows use history at or after their cut-off")
    if row.with_target or row.lost_target or row.foreign_season or row.inference_gameweeks > 1:
        raise ck.QualityError(f"inference rows are not coherent: {row.asDict()}")
    ck.gate(gold.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "matches repeat")
    return gold


def from_silver(spark, sf: str) -> Inputs:
    from kickline.sources import detailed, silver
    s = silver.team_stats(spark, sf)
    named = s.select("season", "fixture_id", "team", *[F.col(f"s{i:02d}").cast("double").alias(c) for i, c in enumerate(detailed.STATS)])
    rich = detailed.derive(named).select("season", "fixture_id", "team", *ct.DETAILED)
    return Inputs(silver.match(spark, sf), silver.team_match(spark, sf), silver.player(spark, sf), silver.league_games(spark, sf), rich)
