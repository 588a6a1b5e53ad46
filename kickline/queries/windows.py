"""Windows per entity (W-*) and the as-of joins on top of them (J-01 to J-03)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickline.operators import windows as win
from kickline.operators.asof import History, asof_attach
from kickline.operators.joins import opponent_value, sized_broadcast
from kickline.operators.squad import squad_windows
from kickline.plans import form
from kickline.queries.base import DAY, query
from kickline.sources import silver

ORDER = ["kick", "fixture_id"]


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("w01_rolling_form", """SELECT season, fixture_id, team,
    round(avg(pts) OVER w3, 6) AS pts_u3, round(avg(gf) OVER w3, 6) AS gf_u3, round(avg(pts) OVER w5, 6) AS pts_u5, round(avg(shots) OVER w5, 6) AS shots_u5
    FROM fx_long WINDOW w3 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 2 PRECEDING), w5 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING)""")
def w01(spark, sf):
    out = {"pts_u3": ("pts", 3), "gf_u3": ("gf", 3), "pts_u5": ("pts", 5), "shots_u5": ("shots", 5)}
    df = win.rolling_mean(silver.team_match(spark, sf).select("season", "fixture_id", "team", "kick", "pts", "gf", "shots"),
                          ["team"], ORDER, out)
    return rounded(df.select("season", "fixture_id", "team", *out), *out)


@query("w02_rolling_in_season", """SELECT season, fixture_id, team, round(avg(pts) OVER w5, 6) AS pts_u5_season, round(avg(sot) OVER w5, 6) AS sot_u5_season
    FROM fx_long WINDOW w5 AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS 4 PRECEDING)""")
def w02(spark, sf):
    out = {"pts_u5_season": ("pts", 5), "sot_u5_season": ("sot", 5)}
    df = win.rolling_mean(silver.team_match(spark, sf).select("season", "fixture_id", "team", "kick", "pts", "sot"),
                          ["season", "team"], ORDER, out)
    return rounded(df.select("season", "fixture_id", "team", *out), *out)


@query("w03_rolling_by_condition", """SELECT season, fixture_id, team, is_home, round(avg(gd) OVER w5, 6) AS gd_cond_u5, round(avg(gc) OVER w5, 6) AS gc_cond_u5
    FROM fx_long WINDOW w5 AS (PARTITION BY team, is_home ORDER BY kick, fixture_id ROWS 4 PRECEDING)""")
def w03(spark, sf):
    out = {"gd_cond_u5": ("gd", 5), "gc_cond_u5": ("gc", 5)}
    df = win.rolling_mean(silver.team_match(spark, sf).select("season", "fixture_id", "team", "is_home", "kick", "gd", "gc"),
                          ["team", "is_home"], ORDER, out)
    return rounded(df.select("season", "fixture_id", "team", "is_home", *out), *out)


@query("w04_running_championship", """SELECT season, fixture_id, team, CAST(sum(pts) OVER w AS BIGINT) AS pts_camp, CAST(sum(gf) OVER w AS BIGINT) AS gf_camp,
    CAST(sum(gc) OVER w AS BIGINT) AS gc_camp, count(*) OVER w AS played_camp, CAST(sum(gd) OVER w AS BIGINT) AS gd_camp, round(sum(pts) OVER w / count(*) OVER w, 6) AS ppg_camp
    FROM fx_long WINDOW w AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)""")
def w04(spark, sf):
    return rounded(form.championship(silver.team_match(spark, sf)).drop("kick"), "ppg_camp")


@query("w05_head_to_head_expanding", """SELECT season, fixture_id, team, rival, round(avg(pts) OVER w, 6) AS h2h_pts, round(avg(gf) OVER w, 6) AS h2h_gf, count(*) OVER w AS h2h_n
    FROM fx_long WINDOW w AS (PARTITION BY team, rival ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)""")
def w05(spark, sf):
    df = win.running_mean(silver.team_match(spark, sf).select("season", "fixture_id", "team", "rival", "kick", "pts", "gf"),
                          ["team", "rival"], ORDER, {"h2h_pts": "pts", "h2h_gf": "gf"}, ordinal="h2h_n")
    return rounded(df.select("season", "fixture_id", "team", "rival", "h2h_pts", "h2h_gf", "h2h_n"), "h2h_pts", "h2h_gf")


@query("w06_calendar_congestion", f"""SELECT season, fixture_id, team, {", ".join(
    f"count(*) OVER (PARTITION BY team ORDER BY kick RANGE BETWEEN {n * DAY - 1} PRECEDING AND CURRENT ROW) AS games_{n}d" for n in (7, 14, 21))} FROM fx_long""")
def w06(spark, sf):
    df = win.trailing_day_counts(silver.team_match(spark, sf).select("season", "fixture_id", "team", "kick"),
                                 ["team"], "kick", {f"games_{n}d": n for n in (7, 14, 21)})
    return df.drop("kick")


@query("w07_streak", """SELECT season, fixture_id, team, round(avg(pts) OVER (PARTITION BY team ORDER BY kick, fixture_id ROWS 2 PRECEDING)
    - avg(pts) OVER (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING), 6) AS streak FROM fx_long""")
def w07(spark, sf):
    return rounded(form.streak(silver.team_match(spark, sf)).select("season", "fixture_id", "team", "streak"), "streak")


@query("w08_squad_continuity", """WITH ord AS (SELECT season, fixture_id, team, row_number() OVER (PARTITION BY team ORDER BY kick, fixture_id) - 1 AS k FROM fx_long),
    pm AS (SELECT o.team, o.k, p.player, sum(p.minutes) AS minutes FROM fx_player p JOIN ord o USING (season, fixture_id, team) WHERE p.minutes > 0 GROUP BY ALL),
    w AS (SELECT team, k + off AS k, player, sum(minutes) AS m FROM pm, (VALUES (0), (1), (2), (3), (4)) v(off) GROUP BY ALL),
    tot AS (SELECT team, k, sum(m) AS t FROM w GROUP BY ALL),
    agg AS (SELECT w.team, w.k, sum(m * m) / (t * t) AS hhi, sum(m) FILTER (WHERE pm.player IS NOT NULL) / t AS cont
      FROM w JOIN tot USING (team, k) LEFT JOIN pm ON pm.team = w.team AND pm.k = w.k AND pm.player = w.player GROUP BY w.team, w.k, t)
    SELECT season, fixture_id, ord.team, round(hhi, 9) AS minutes_hhi, round(cont, 9) AS squad_continuity FROM ord LEFT JOIN agg ON ord.team = agg.team AND ord.k = agg.k""")
def w08(spark, sf):
    ordered = form.ordinals(silver.team_match(spark, sf))
    df = squad_windows(silver.player(spark, sf), ordered)
    return rounded(df.select("season", "fixture_id", "team", "minutes_hhi", "squad_continuity"), "minutes_hhi", "squad_continuity", digits=9)


@query("w09_detailed_stats_windows", "SELECT season, fixture_id, team, " + ", ".join(
    f"round(avg(s{i:02d}) OVER w{n}, 6) AS s{i:02d}_u{n}" for n in (3, 5) for i in range(14))
    + """ FROM fx_stats WINDOW w3 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 2 PRECEDING), w5 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING)""")
def w09(spark, sf):
    out = {f"s{i:02d}_u{n}": (f"s{i:02d}", n) for n in (3, 5) for i in range(14)}
    df = win.rolling_mean(silver.team_stats(spark, sf), ["team"], ORDER, out)
    return rounded(df.select("season", "fixture_id", "team", *out), *out)


@query("w10_form_all_competitions", """SELECT event_id, team, round(avg(CASE WHEN gf > gc THEN 3 WHEN gf = gc THEN 1 ELSE 0 END) OVER w, 6) AS pts_all_u5,
    round(avg(gf) OVER w, 6) AS gf_all_u5, round(avg(gc) OVER w, 6) AS gc_all_u5 FROM fx_comp WHERE finished
    WINDOW w AS (PARTITION BY team ORDER BY kick, event_id ROWS 4 PRECEDING)""")
def w10(spark, sf):
    from kickline.plans.competitions import all_competition_form
    df = all_competition_form(silver.competition_match(spark, sf))
    cols = ["pts_all_u5", "gf_all_u5", "gc_all_u5"]
    return rounded(df.select("event_id", "team", *cols), *cols)


@query("w11_rating_momentum", """SELECT event_id, team, """ + ", ".join(
    f"gf - lag(gf, {n}) OVER (PARTITION BY team ORDER BY kick, event_id) AS delta_{n}" for n in (3, 5, 10)) + " FROM fx_comp")
def w11(spark, sf):
    df = silver.competition_match(spark, sf).select("event_id", "team", "kick", "gf")
    return win.lag_diff(df, ["team"], ["kick", "event_id"], "gf", {f"delta_{n}": n for n in (3, 5, 10)}).drop("kick", "gf")


@query("w12_surprise_windows", """WITH s AS (SELECT l.season, l.fixture_id, l.team, l.kick, abs(CASE WHEN gf > gc THEN 1.0 WHEN gf = gc THEN 0.5 ELSE 0.0 END
      - CASE WHEN is_home THEN p_home + p_draw / 2 ELSE p_away + p_draw / 2 END) AS surprise FROM fx_long l JOIN fx_pred p USING (season, fixture_id))
    SELECT season, fixture_id, team, round(avg(surprise) OVER (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING), 6) AS surprise_u5,
    round(avg(surprise) OVER (PARTITION BY team ORDER BY kick, fixture_id ROWS 9 PRECEDING), 6) AS surprise_u10 FROM s""")
def w12(spark, sf):
    p = silver.forecast(spark, sf).select("season", "fixture_id", "p_home", "p_draw", "p_away")
    real = F.when(F.col("gf") > F.col("gc"), 1.0).when(F.col("gf") == F.col("gc"), 0.5).otherwise(0.0)
    exp = F.when(F.col("is_home"), F.col("p_home")).otherwise(F.col("p_away")) + F.col("p_draw") / 2
    df = (silver.team_match(spark, sf).join(p, ["season", "fixture_id"])
          .select("season", "fixture_id", "team", "kick", F.abs(real - exp).alias("surprise")))
    out = {"surprise_u5": ("surprise", 5), "surprise_u10": ("surprise", 10)}
    return rounded(win.rolling_mean(df, ["team"], ORDER, out).drop("kick", "surprise"), *out)


@query("w13_ratio_windows", """WITH r AS (SELECT a.season, a.fixture_id, a.team, a.kick, a.sot / nullif(a.shots, 0) AS share, b.sot / nullif(b.shots, 0) AS share_conc,
      b.shots AS shots_conc, a.gf - a.sot * 0.3 AS over FROM fx_long a JOIN fx_long b ON a.season = b.season AND a.fixture_id = b.fixture_id AND a.team <> b.team)
    SELECT season, fixture_id, team, round(avg(share) OVER w, 6) AS sot_share_u5, round(avg(share_conc) OVER w, 6) AS sot_share_conc_u5,
    round(avg(shots_conc) OVER w, 6) AS shots_conc_u5, round(avg(over) OVER w, 6) AS over_u5 FROM r WINDOW w AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING)""")
def w13(spark, sf):
    df = opponent_value(silver.team_match(spark, sf).select("season", "fixture_id", "team", "kick", "sot", "shots", "gf"),
                        ["season", "fixture_id"], "team", {"sot_conc": "sot", "shots_conc": "shots"})
    share = F.try_divide(F.col("sot"), F.col("shots"))
    conc = F.try_divide(F.col("sot_conc"), F.col("shots_conc"))
    out = {"sot_share_u5": (share, 5), "sot_share_conc_u5": (conc, 5), "shots_conc_u5": ("shots_conc", 5),
           "over_u5": (F.col("gf") - F.col("sot") * 0.3, 5)}
    df = win.rolling_mean(df, ["team"], ORDER, out)
    return rounded(df.select("season", "fixture_id", "team", *out), *out)


@query("w14_validity_intervals", """SELECT player_id, valuation_id, club, day AS valid_from,
    coalesce(lead(day) OVER (PARTITION BY player_id ORDER BY day, valuation_id), epoch_us(TIMESTAMP '2099-12-31')) AS valid_to FROM fx_valuation""")
def w14(spark, sf):
    from kickline.operators.intervals import validity
    return validity(silver.valuation(spark, sf).select("player_id", "valuation_id", "club", "day"),
                    ["player_id"], "day", "valuation_id").drop("day")


@query("w15_match_ordinal", "SELECT season, fixture_id, team, row_number() OVER (PARTITION BY team ORDER BY kick, fixture_id) - 1 AS k FROM fx_long")
def w15(spark, sf):
    return form.ordinals(silver.team_match(spark, sf)).select("season", "fixture_id", "team", "k")


@query("w16_group_minimum", "SELECT season, gameweek, fixture_id, kick - min(kick) OVER (PARTITION BY season, gameweek) AS after_first_us FROM fx_match")
def w16(spark, sf):
    m = silver.match(spark, sf).select("season", "gameweek", "fixture_id", "kick")
    # pre-aggregated and joined back: no task holds a whole gameweek
    first = silver.cutoffs(spark, sf)
    return (m.join(sized_broadcast(first), ["season", "gameweek"])
            .select("season", "gameweek", "fixture_id", (F.col("kick") - F.col("cutoff")).alias("after_first_us")))


@query("w17_drawdown_by_model", """WITH b AS (SELECT season, fixture_id, cls, CASE WHEN cls = result THEN odds - 1 ELSE -1.0 END AS gain, kick,
        CASE cls WHEN 'away' THEN 0 WHEN 'draw' THEN 1 ELSE 2 END AS cls_no FROM (
      SELECT season, fixture_id, kick, result, 'away' AS cls, p_away AS p, odds_away AS odds FROM fx_pred UNION ALL
      SELECT season, fixture_id, kick, result, 'draw', p_draw, odds_draw FROM fx_pred UNION ALL
      SELECT season, fixture_id, kick, result, 'home', p_home, odds_home FROM fx_pred) WHERE p * odds - 1 > 0.05),
    c AS (SELECT *, sum(CAST(round(gain * 10) AS BIGINT)) OVER (PARTITION BY season ORDER BY kick, cls_no ROWS UNBOUNDED PRECEDING) AS cum FROM b),
    d AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY season ORDER BY kick, cls_no ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
    SELECT season, count(*) AS n_bets, round(max(peak - cum) / 10, 6) AS max_drawdown, round(sum(gain), 4) AS net FROM d GROUP BY season""")
def w17(spark, sf):
    from kickline.operators.betting import candidates, drawdown
    bets = candidates(silver.forecast(spark, sf), 0.05, keep=["season", "fixture_id", "kick", "result"])
    dd = drawdown(bets, ["season"], ["kick", "class_no"])
    net = bets.groupBy("season").agg(F.count(F.lit(1)).alias("n_bets"), F.round(F.sum("gain"), 4).alias("net"))
    return net.join(dd, "season").select("season", "n_bets", F.round("max_drawdown", 6).alias("max_drawdown"), "net")


@query("w18_version_deltas", """WITH v AS (SELECT season, gameweek, count(*) AS n, sum(home_goals + away_goals) AS goals FROM fx_match GROUP BY ALL)
    SELECT season, gameweek, n, n - lag(n) OVER w AS d_rows, CAST(goals - lag(goals) OVER w AS BIGINT) AS d_goals FROM v WINDOW w AS (PARTITION BY season ORDER BY gameweek)""")
def w18(spark, sf):
    v = (silver.match(spark, sf).groupBy("season", "gameweek")
         .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals")))
    w = Window.partitionBy("season").orderBy("gameweek")   # at most 53 rows per season
    return v.select("season", "gameweek", "n", (F.col("n") - F.lag("n").over(w)).alias("d_rows"),
                    (F.col("goals") - F.lag("goals").over(w)).alias("d_goals"))


@query("w19_team_maximum", "SELECT season, fixture_id, team, count(*) OVER (PARTITION BY team) - 1 AS last_k FROM fx_long")
def w19(spark, sf):
    ks = form.ordinals(silver.team_match(spark, sf)).select("season", "fixture_id", "team", "k")
    top = ks.groupBy("team").agg(F.max("k").alias("last_k"))
    return ks.drop("k").join(sized_broadcast(top), "team").select("season", "fixture_id", "team", "last_k")


# -- as-of joins ----------------------------------------------------------------------------------

@query("j01_asof_strict", """WITH h AS (SELECT team, kick, avg(pts) OVER (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING) AS pts_u5 FROM fx_long)
    SELECT o.season, o.fixture_id, o.team, o.is_home, round(h.pts_u5, 6) AS pts_u5, h.kick AS hist_kick FROM fx_obj o ASOF LEFT JOIN h ON o.team = h.team AND o.cutoff > h.kick""")
def j01(spark, sf):
    long = silver.team_match(spark, sf)
    hist = win.rolling_mean(long.select("team", "kick", "fixture_id", "pts"), ["team"], ORDER, {"pts_u5": ("pts", 5)})
    df = asof_attach(form.objectives(long), ["team"], "cutoff",
                     [History(hist, "kick", ["pts_u5"], tie="fixture_id", used_time="hist_kick")])
    return rounded(df.select("season", "fixture_id", "team", "is_home", "pts_u5", "hist_kick"), "pts_u5")


_H2H = """SELECT team, rival, kick, avg(pts) OVER w AS pts, avg(gf) OVER w AS gf, avg(gc) OVER w AS gc, count(*) OVER w AS n FROM fx_long {where}
    WINDOW w AS (PARTITION BY team, rival ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)"""


@query("j02_head_to_head_asof", f"""WITH ha AS ({_H2H.format(where="")}), hh AS ({_H2H.format(where="WHERE is_home")}), hv AS ({_H2H.format(where="WHERE NOT is_home")}),
    o AS (SELECT season, fixture_id, home, away, cutoff FROM fx_match JOIN fx_cut USING (season, gameweek))
    SELECT o.season, o.fixture_id, round(a.pts, 6) AS h2h_pts_home, round(b.pts, 6) AS h2h_pts_away, round(a.gf, 6) AS h2h_gf_home, round(a.gc, 6) AS h2h_gc_home, least(coalesce(a.n, 0), 4) AS h2h_n,
    round(c.pts, 6) AS h2h_cond_pts_home, round(d.pts, 6) AS h2h_cond_pts_away, round(c.gf, 6) AS h2h_cond_gf_home, round(c.gc, 6) AS h2h_cond_gc_home, least(coalesce(c.n, 0), 2) AS h2h_cond_n
    FROM o ASOF LEFT JOIN ha a ON a.team = o.home AND a.rival = o.away AND o.cutoff > a.kick ASOF LEFT JOIN ha b ON b.team = o.away AND b.rival = o.home AND o.cutoff > b.kick
    ASOF LEFT JOIN hh c ON c.team = o.home AND c.rival = o.away AND o.cutoff > c.kick ASOF LEFT JOIN hv d ON d.team = o.away AND d.rival = o.home AND o.cutoff > d.kick""")
def j02(spark, sf):
    df = form.head_to_head(silver.team_match(spark, sf))
    return rounded(df, *[c for c in df.columns if c.startswith("h2h") and not c.endswith("_n")])


@query("j03_grid_asof_table", """WITH camp AS (SELECT season, team, kick, sum(pts) OVER w AS pts, sum(gd) OVER w AS gd, sum(gf) OVER w AS gf FROM fx_long
      WINDOW w AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT season, gameweek, cutoff, team FROM fx_cut JOIN (SELECT DISTINCT season, team FROM fx_long) USING (season))
    SELECT g.season, g.gameweek, g.team, CAST(coalesce(pts, 0) AS BIGINT) AS pts_camp, CAST(coalesce(gd, 0) AS BIGINT) AS gd_camp, CAST(coalesce(gf, 0) AS BIGINT) AS gf_camp
    FROM g ASOF LEFT JOIN camp c ON g.season = c.season AND g.team = c.team AND g.cutoff > c.kick""")
def j03(spark, sf):
    return form.table_grid(silver.team_match(spark, sf)).drop("cutoff")


@query("o01_league_table", """WITH camp AS (SELECT season, team, kick, sum(pts) OVER w AS pts, sum(gd) OVER w AS gd, sum(gf) OVER w AS gf FROM fx_long
      WINDOW w AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT season, gameweek, cutoff, team FROM fx_cut JOIN (SELECT DISTINCT season, team FROM fx_long) USING (season)),
    t AS (SELECT g.season, g.gameweek, g.cutoff, g.team, coalesce(pts, 0) AS pts, coalesce(gd, 0) AS gd, coalesce(gf, 0) AS gf FROM g ASOF LEFT JOIN camp c ON g.season = c.season AND g.team = c.team AND g.cutoff > c.kick)
    SELECT season, gameweek, team, CAST(row_number() OVER (PARTITION BY season, cutoff ORDER BY pts DESC, gd DESC, gf DESC, team) AS INT) AS position FROM t""")
def o01(spark, sf):
    return form.league_table(silver.team_match(spark, sf)).select("season", "gameweek", "team", "position")
