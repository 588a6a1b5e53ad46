"""Aggregations (A-*)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickline.operators import calendar as cal
from kickline.operators import coldstart as cold
from kickline.operators import players as pl
from kickline.operators.asof import History, asof_attach
from kickline.operators.intervals import valid_at, validity
from kickline.operators.joins import sized_broadcast
from kickline.operators.profile import class_shares, drift_table, null_profile, share_by
from kickline.operators.scoring import CLASSES, auc, argmax_class, log_loss_term, market_argmax, prob_of, probs
from kickline.functions.market import implied, overround
from kickline.operators.windows import DAY_US, running
from kickline.queries.base import DAY, query
from kickline.queries.joins import _LABEL, _VALID, played_until
from kickline.queries.windows import rounded
from kickline.sources import silver

NOW = "epoch_us(TIMESTAMP '2001-07-01')"
MASK = {1996: 16}   # season whose first gameweeks publish zeros


@query("a01_cutoff_per_gameweek", "SELECT season, gameweek, cutoff FROM fx_cut")
def a01(spark, sf):
    return silver.cutoffs(spark, sf)


@query("a02_deadline_minimum", "SELECT season, gameweek, min(kick - 5400000000) AS deadline FROM fx_match GROUP BY ALL")
def a02(spark, sf):
    fx = silver.match(spark, sf).select("season", "gameweek", (F.col("kick") - cal.DEADLINE_OFFSET_US).alias("_d"))
    return cal.cutoff_per_gameweek(fx, "_d", out="deadline")


@query("a03_deadline_with_provenance", f"""SELECT m.season, m.gameweek, m.fixture_id, coalesce(p.at, c.cutoff - 5400000000) AS deadline, CASE WHEN p.at IS NULL THEN 'derived' ELSE 'api' END AS deadline_source
    FROM fx_match m JOIN fx_cut c USING (season, gameweek) LEFT JOIN (SELECT season, gameweek, cutoff - {DAY} AS at FROM fx_cut WHERE season = 2001) p USING (season, gameweek)""")
def a03(spark, sf):
    m = silver.match(spark, sf)
    published = (silver.cutoffs(spark, sf).filter(F.col("season") == 2001)   # only the current season is published
                 .select("season", "gameweek", (F.col("cutoff") - DAY_US).alias("published_at")))
    d = cal.deadlines(m, "kick", published)
    return m.select("season", "gameweek", "fixture_id").join(sized_broadcast(d), ["season", "gameweek"])


STATS_SQL = """st AS (SELECT season, gameweek, fixture_id, team, sum(xg) AS xg, sum(xa) AS xa, count(*) FILTER (WHERE minutes > 0) AS n_players, CAST(sum(saves) AS BIGINT) AS saves,
      sum(saves) / nullif(sum(saves) + max(conceded), 0) AS save_rate,
      """ + ", ".join(f"CAST(coalesce(sum(points) FILTER (WHERE position = '{k}'), 0) AS BIGINT) AS pts_{v}" for k, v in pl.POSITIONS.items()) + """ FROM fx_player GROUP BY ALL),
    ts AS (SELECT a.*, b.xg AS xgc FROM st a JOIN st b ON a.season = b.season AND a.fixture_id = b.fixture_id AND a.team <> b.team)"""


@query("a04_player_to_team_fixture", f"""WITH {STATS_SQL} SELECT season, gameweek, fixture_id, team, round(xg, 6) AS xg, round(xa, 6) AS xa, round(xgc, 6) AS xgc, n_players, saves FROM ts""")
def a04(spark, sf):
    df = pl.team_stats_by_fixture(silver.player(spark, sf))
    return rounded(df.select("season", "gameweek", "fixture_id", "team", "xg", "xa", "xgc", "n_players", "saves"), "xg", "xa", "xgc")


@query("a05_save_rate", f"WITH {STATS_SQL} SELECT season, fixture_id, team, round(save_rate, 9) AS save_rate FROM st")
def a05(spark, sf):
    return rounded(pl.by_fixture(silver.player(spark, sf)).select("season", "fixture_id", "team", "save_rate"), "save_rate", digits=9)


@query("p09_points_by_position", f"WITH {STATS_SQL} SELECT season, fixture_id, team, pts_gk, pts_def, pts_mid, pts_fwd FROM st")
def p09(spark, sf):
    return pl.by_fixture(silver.player(spark, sf)).select("season", "fixture_id", "team", "pts_gk", "pts_def", "pts_mid", "pts_fwd")


_UNKNOWN = "season = 1996 AND gameweek < 16"


@query("p15_mask_false_zeros", f"""WITH {STATS_SQL} SELECT season, gameweek, fixture_id, team, CASE WHEN NOT ({_UNKNOWN}) THEN round(xg, 6) END AS xg,
    CASE WHEN NOT ({_UNKNOWN}) THEN round(xgc, 6) END AS xgc, NOT ({_UNKNOWN}) AS xg_available FROM ts""")
def p15(spark, sf):
    df = pl.team_stats_by_fixture(silver.player(spark, sf), MASK)
    return rounded(df.select("season", "gameweek", "fixture_id", "team", "xg", "xgc", "xg_available"), "xg", "xgc")


@query("p16_availability_flag", f"""WITH {STATS_SQL} SELECT l.season, l.fixture_id, coalesce(NOT (ts.season = 1996 AND ts.gameweek < 16), false) AND ts.xg IS NOT NULL AND NOT coalesce(ts.season = 1996 AND ts.gameweek < 16, false) AS xg_available
    FROM fx_long l LEFT JOIN ts USING (season, fixture_id, team) WHERE l.is_home""")
def p16(spark, sf):
    stats = pl.team_stats_by_fixture(silver.player(spark, sf), MASK).select("season", "fixture_id", "team", "xg", "xg_available")
    home = silver.team_match(spark, sf).filter("is_home").select("season", "fixture_id", "team")
    return (home.join(stats, ["season", "fixture_id", "team"], "left")
            .select("season", "fixture_id", (F.coalesce("xg_available", F.lit(False)) & F.col("xg").isNotNull()).alias("xg_available")))


@query("a06_entity_registry", """SELECT c_nationkey AS code, arg_max(c_name, c_custkey) AS last_name, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons, count(DISTINCT season) AS n_seasons
    FROM customer JOIN fx_match ON away_id = c_custkey GROUP BY 1""")
def a06(spark, sf):
    c = silver.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("code"))
    m = silver.match(spark, sf).select("season", F.col("away_id").alias("c_custkey"))
    listed = m.distinct().join(c, "c_custkey")
    seasons = listed.select("code", "season").distinct().groupBy("code").agg(
        F.array_join(F.sort_array(F.collect_set(F.col("season").cast("string"))), ",").alias("seasons"),   # one entry per season
        F.count(F.lit(1)).alias("n_seasons"))
    last = listed.groupBy("code").agg(F.max_by("c_name", "c_custkey").alias("last_name"))
    return last.join(seasons, "code").select("code", "last_name", "seasons", "n_seasons")


@query("a07_functional_dependency", "SELECT season, player, count(DISTINCT team) AS n_values FROM fx_player GROUP BY ALL HAVING count(DISTINCT team) > 1")
def a07(spark, sf):
    from kickline.operators.checks import dependency_violations
    return dependency_violations(silver.player(spark, sf), ["season", "player"], "team")


@query("a08_first_season", """WITH d AS (SELECT DISTINCT season, team FROM fx_club), f AS (SELECT team, min(season) AS first_season FROM d GROUP BY team)
    SELECT d.season, d.team, f.first_season, d.season = f.first_season AND d.season <> 1995 AS promoted FROM d JOIN f USING (team)""")
def a08(spark, sf):
    dim = silver.club_match(spark, sf).select("season", "team").distinct()
    return cold.first_season(dim, "team", 1995).select("season", "team", "first_season", "promoted")


_FLAGS = """d AS (SELECT DISTINCT season, team FROM fx_club), s AS (SELECT season, lag(season) OVER (ORDER BY season) AS prev FROM (SELECT DISTINCT season FROM d)),
    fl AS (SELECT d.season, d.team, CASE WHEN s.prev IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM d b WHERE b.team = d.team AND b.season = s.prev) END AS promoted FROM d JOIN s USING (season))"""


@query("a09_promoted_flag", f"WITH {_FLAGS} SELECT season, team, promoted FROM fl")
def a09(spark, sf):
    return cold.promoted_flags(silver.club_match(spark, sf), "team")


@query("a10_promoted_prior", f"""WITH {_FLAGS}, r AS (SELECT c.*, row_number() OVER (PARTITION BY season, team ORDER BY kick, fixture_id) AS rn FROM fx_club c JOIN fl USING (season, team) WHERE promoted AND season < 2001)
    SELECT count(*) AS n_rows, round(avg(pts), 6) AS pts, round(avg(gf), 6) AS gf, round(avg(gc), 6) AS gc, round(avg(shots), 6) AS shots FROM r WHERE rn <= 5""")
def a10(spark, sf):
    club = silver.club_match(spark, sf)
    prior = cold.promoted_prior(club, cold.promoted_flags(club, "team"), ["pts", "gf", "gc", "shots"], list(range(1995, 2001)))
    return rounded(prior, "pts", "gf", "gc", "shots")


@query("a11_fill_from_prior", f"""WITH {_FLAGS}, r AS (SELECT c.*, row_number() OVER (PARTITION BY season, team ORDER BY kick, fixture_id) AS rn FROM fx_club c JOIN fl USING (season, team) WHERE promoted AND season < 2001),
    prior AS (SELECT avg(pts) AS pts FROM r WHERE rn <= 5),
    h AS (SELECT team, kick, avg(pts) OVER w AS pts_u5, count(*) OVER w0 AS n FROM fx_club WINDOW w AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING), w0 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT c.season, c.fixture_id, c.team, u.cutoff FROM fx_club c JOIN fx_cut u USING (season, gameweek)),
    a AS (SELECT o.*, h.pts_u5, coalesce(h.n, 0) AS n_hist FROM o ASOF LEFT JOIN h ON h.team = o.team AND o.cutoff > h.kick)
    SELECT a.season, a.fixture_id, a.team, a.n_hist AS away_n_hist, fl.promoted AS away_promoted,
    round(CASE WHEN n_hist = 0 AND coalesce(promoted, false) AND pts_u5 IS NULL THEN prior.pts ELSE pts_u5 END, 6) AS away_pts_u5 FROM a JOIN fl USING (season, team), prior""")
def a11(spark, sf):
    from kickline.operators.windows import rolling_mean
    club = silver.club_match(spark, sf)
    flags = cold.promoted_flags(club, "team")
    prior = cold.promoted_prior(club, flags, ["pts"], list(range(1995, 2001))).select("pts")
    hist = rolling_mean(club.select("team", "kick", "fixture_id", "pts"), ["team"], ["kick", "fixture_id"], {"away_pts_u5": ("pts", 5)})
    hist = running(hist, ["team"], ["kick", "fixture_id"], ordinal="away_n_hist")
    obj = club.select("season", "gameweek", "fixture_id", "team").join(sized_broadcast(silver.cutoffs(spark, sf)), ["season", "gameweek"])
    wide = asof_attach(obj, ["team"], "cutoff", [History(hist, "kick", ["away_pts_u5", "away_n_hist"], tie="fixture_id")])
    wide = (wide.join(flags.withColumnRenamed("promoted", "away_promoted"), ["season", "team"])
            .withColumn("away_n_hist", F.coalesce("away_n_hist", F.lit(0)))
            .select("season", "fixture_id", "team", "away_n_hist", "away_promoted", "away_pts_u5"))
    return rounded(cold.apply_prior(wide, prior, ("home", "away")), "away_pts_u5")


@query("a12_minutes_concentration", """WITH p AS (SELECT season, fixture_id, team, player, sum(minutes) AS m FROM fx_player WHERE minutes > 0 GROUP BY ALL)
    SELECT season, fixture_id, team, round(CAST(sum(m * m) AS DOUBLE) / (sum(m) * sum(m)), 9) AS hhi, count(*) AS n FROM p GROUP BY ALL""")
def a12(spark, sf):
    p = (silver.player(spark, sf).filter(F.col("minutes") > 0).groupBy("season", "fixture_id", "team", "player")
         .agg(F.sum("minutes").alias("m")))
    return (p.groupBy("season", "fixture_id", "team")
            .agg(F.round(F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m")), 9).alias("hhi"), F.count(F.lit(1)).alias("n")))


@query("a13_squad_value_by_line", f"""WITH {_VALID} SELECT cutoff, club, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value) FILTER (WHERE rn <= 11) AS BIGINT) AS top11,
    """ + ", ".join(f"CAST(coalesce(sum(value) FILTER (WHERE line = '{x}'), 0) AS BIGINT) AS value_{x}" for x in ("gk", "def", "mid", "fwd")) + " FROM hit GROUP BY ALL")
def a13(spark, sf):
    v = validity(silver.valuation(spark, sf), ["player_id"], "day", "valuation_id")
    lines = {f"value_{x}": F.when(F.col("line") == x, F.col("value")).otherwise(0) for x in ("gk", "def", "mid", "fwd")}
    out = valid_at(v, ["club"], silver.cutoffs(spark, sf).select("cutoff"), "cutoff", "value",
                   {"total": F.col("value"), **lines}, top_n=11)
    return out.select("cutoff", "club", "total", "top11", *lines)


@query("a14_class_shares", "SELECT season, " + ", ".join(f"round(avg(CASE WHEN result = '{c}' THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in CLASSES) + " FROM fx_match GROUP BY season")
def a14(spark, sf):
    return rounded(class_shares(silver.match(spark, sf), ["season"], "result", list(CLASSES)), *CLASSES)


_PROFILED = ["gameweek", "fixture_id", "kick", "match_date", "home", "away", "division", "home_id", "away_id", "result"] + [f"{side}_{c}" for side in ("home", "away")
             for c in ("goals", "shots", "sot", "corners", "fouls", "yellows", "reds")] + ["fdr_home", "fdr_away", "odds_home", "odds_draw", "odds_away", "w_home", "w_draw", "w_away", "wb_home", "wb_draw", "wb_away"]


@query("a15_null_profile", " UNION ALL ".join(
    f"SELECT season, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, round(count({c}) / count(*), 6) AS coverage FROM fx_match GROUP BY season"
    for c in _PROFILED))
def a15(spark, sf):
    """Every column of the match table but the grouping one."""
    m = silver.match(spark, sf)
    return rounded(null_profile(m, ["season"], [c for c in m.columns if c != "season"]), "coverage")


_MKT = "1 / odds_{c} / (1 / odds_home + 1 / odds_draw + 1 / odds_away)"
VERSUS_SQL = f"""mk AS (SELECT *, {", ".join(f"{_MKT.format(c=c)} AS m_{c}" for c in CLASSES)} FROM fx_pred WHERE odds_home IS NOT NULL),
    vs AS (SELECT season, gameweek, result, {_LABEL.format(p="p")} AS said, CASE WHEN m_home >= m_draw AND m_home >= m_away THEN 'home' WHEN m_draw >= m_away THEN 'draw' ELSE 'away' END AS mkt,
      -ln(CASE result WHEN 'away' THEN p_away WHEN 'draw' THEN p_draw ELSE p_home END) AS ll, -ln(CASE result WHEN 'away' THEN m_away WHEN 'draw' THEN m_draw ELSE m_home END) AS ll_mkt,
      greatest(m_home, m_draw, m_away) AS favour, p_draw, m_draw FROM mk)"""
_HIT = "round(avg(CASE WHEN said = result THEN 1.0 ELSE 0.0 END), 6) AS acc_model, round(avg(CASE WHEN mkt = result THEN 1.0 ELSE 0.0 END), 6) AS acc_market, round(avg(ll), 6) AS ll_model, round(avg(ll_mkt), 6) AS ll_market"


def versus(spark, sf):
    f = silver.forecast(spark, sf).filter(F.col("odds_home").isNotNull())
    m = implied(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    f = f.withColumns({f"m_{k}": v for k, v in m.items()})
    return f.select("season", "gameweek", "result", argmax_class(*probs("p")).alias("said"), market_argmax(*probs("m")).alias("mkt"),
                    log_loss_term(prob_of(F.col("result"), *probs("p"))).alias("ll"),
                    log_loss_term(prob_of(F.col("result"), *probs("m"))).alias("ll_mkt"),
                    F.greatest(*probs("m")).alias("favour"), "p_draw", "m_draw")


def _hits():
    def acc(c, name):
        return F.round(F.avg((F.col(c) == F.col("result")).cast("double")), 6).alias(name)
    return [acc("said", "acc_model"), acc("mkt", "acc_market"), F.round(F.avg("ll"), 6).alias("ll_model"),
            F.round(F.avg("ll_mkt"), 6).alias("ll_market")]


@query("a16_versus_market_by_gameweek", f"WITH {VERSUS_SQL} SELECT season, gameweek, count(*) AS n, {_HIT}, round(avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END), 6) AS acc_home FROM vs GROUP BY ALL")
def a16_gw(spark, sf):
    return versus(spark, sf).groupBy("season", "gameweek").agg(
        F.count(F.lit(1)).alias("n"), *_hits(), F.round(F.avg((F.col("result") == "home").cast("double")), 6).alias("acc_home"))


@query("a16_versus_market_by_class", f"WITH {VERSUS_SQL} SELECT result, count(*) AS n, round(avg(ll), 6) AS ll_model, round(avg(ll_mkt), 6) AS ll_market, round(avg(exp(-ll)), 6) AS p_model, round(avg(exp(-ll_mkt)), 6) AS p_market FROM vs GROUP BY result")
def a16_class(spark, sf):
    return versus(spark, sf).groupBy("result").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ll"), 6).alias("ll_model"), F.round(F.avg("ll_mkt"), 6).alias("ll_market"),
        F.round(F.avg(F.exp(-F.col("ll"))), 6).alias("p_model"), F.round(F.avg(F.exp(-F.col("ll_mkt"))), 6).alias("p_market"))


@query("a16_versus_market_by_agreement", f"WITH {VERSUS_SQL} SELECT CASE WHEN said = mkt THEN 'agree' ELSE 'disagree' END AS situation, count(*) AS n, {_HIT} FROM vs GROUP BY 1")
def a16_agree(spark, sf):
    return (versus(spark, sf).groupBy(F.when(F.col("said") == F.col("mkt"), "agree").otherwise("disagree").alias("situation"))
            .agg(F.count(F.lit(1)).alias("n"), *_hits()))


@query("a17_by_favourite_band", f"""WITH {VERSUS_SQL} SELECT CASE WHEN favour <= 0.40 THEN 'to 0.40' WHEN favour <= 0.50 THEN 'to 0.50' WHEN favour <= 0.60 THEN 'to 0.60' ELSE 'to 1.00' END AS band, count(*) AS n, {_HIT} FROM vs GROUP BY 1""")
def a17(spark, sf):
    f = F.col("favour")
    band = F.when(f <= 0.40, "to 0.40").when(f <= 0.50, "to 0.50").when(f <= 0.60, "to 0.60").otherwise("to 1.00")
    return versus(spark, sf).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), *_hits())


_DRIFT = {"home_goals": "home_goals", "away_goals": "away_goals", "total_goals": "home_goals + away_goals", "home_shots": "home_shots",
          "home_sot": "home_sot", "home_corners": "home_corners", "implied_home": "1 / odds_home"}


@query("a18_drift", "WITH s AS (SELECT season, " + ", ".join(f"avg({e}) AS {n}" for n, e in _DRIFT.items()) + " FROM fx_match GROUP BY season) "
       + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6) AS mean, round((max({n}) - min({n})) / avg({n}), 6) AS variation FROM s" for n in _DRIFT))
def a18(spark, sf):
    return rounded(drift_table(silver.match(spark, sf), ["season"], {n: F.expr(e) for n, e in _DRIFT.items()}), "mean", "variation")


@query("a19_matches_per_team", """WITH c AS (SELECT team, count(*) AS n FROM fx_long GROUP BY team)
    SELECT t.name AS team, coalesce(c.n, 0) AS n_matches FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region) t LEFT JOIN c ON c.team = t.name""")
def a19(spark, sf):
    counts = (silver.team_match(spark, sf).groupBy("team").agg(F.count(F.lit(1)).alias("n")))
    current = (silver.table(spark, sf, "nation").select(F.col("n_name").alias("team"))
               .union(silver.table(spark, sf, "region").select("r_name")))
    return current.join(counts, "team", "left").select("team", F.coalesce("n", F.lit(0)).alias("n_matches"))


_PLAYED = f"kick < {NOW} AND fixture_id % 97 <> 0"
STATUS_SQL = f"""fx AS (SELECT m.*, c.cutoff, ({_PLAYED}) AS played, NOT ({_PLAYED}) AND c.cutoff < {NOW} - {7 * DAY} AS postponed FROM fx_match m JOIN fx_cut c USING (season, gameweek)),
    st AS (SELECT season, gameweek, cutoff, count(*) AS n, count(*) FILTER (WHERE played) AS n_played, count(*) FILTER (WHERE NOT played AND NOT postponed) AS n_pending FROM fx GROUP BY ALL),
    pv AS (SELECT st.season, st.gameweek, count(p.kick) AS prev_n, count(*) FILTER (WHERE p.played) AS prev_played, count(*) FILTER (WHERE NOT p.played AND NOT p.postponed) AS prev_pending
      FROM st LEFT JOIN fx p ON p.season = st.season AND p.kick < st.cutoff GROUP BY ALL),
    status AS (SELECT st.*, prev_n, prev_played, prev_pending, prev_pending = 0 AS final, CASE WHEN n_played = n THEN 'complete' WHEN n_played > 0 THEN 'in_progress' ELSE 'pending' END AS situation FROM st JOIN pv USING (season, gameweek))"""


def gw_status(spark, sf):
    played = (F.col("kick") < played_until()) & (F.col("fixture_id") % 97 != 0)
    return cal.gameweek_status(silver.match(spark, sf).select("season", "gameweek", "fixture_id", "kick"), played, played_until())


@query("a20_gameweek_status", f"WITH {STATUS_SQL} SELECT * FROM status")
def a20(spark, sf):
    return gw_status(spark, sf)


@query("a21_complete_gameweeks", f"WITH {STATUS_SQL} SELECT season, gameweek FROM status WHERE situation = 'complete'")
def a21(spark, sf):
    return gw_status(spark, sf).filter(F.col("situation") == "complete").select("season", "gameweek")


@query("o05_next_predictable", f"WITH {STATUS_SQL} SELECT season, min(gameweek) AS next_gameweek FROM status WHERE n_pending > 0 AND final GROUP BY season")
def o05(spark, sf):
    return cal.next_predictable(gw_status(spark, sf))


@query("a22_season_index", f"""WITH g AS (SELECT DISTINCT season, CAST(unnest(range(1, (SELECT max(gameweek) + 1 FROM fx_match))) AS INT) AS gameweek FROM fx_match), a AS (SELECT season, gameweek, count(*) AS n, count(*) FILTER (WHERE kick < {NOW}) AS n_played, min(kick) AS cutoff FROM fx_match GROUP BY ALL)
    SELECT g.season, g.gameweek, coalesce(n, 0) AS n, coalesce(n_played, 0) AS n_played, cutoff, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n = n_played THEN 'complete' WHEN n_played > 0 THEN 'in_progress' ELSE 'pending' END AS state FROM g LEFT JOIN a USING (season, gameweek)""")
def a22(spark, sf):
    return cal.season_index(silver.match(spark, sf).select("season", "gameweek", "kick"), F.col("kick") < played_until())


@query("a23_leakage_audit", f"""WITH o AS (SELECT o.*, h.kick AS hist FROM fx_obj o ASOF LEFT JOIN (SELECT team, kick FROM fx_long) h ON h.team = o.team AND o.cutoff > h.kick)
    SELECT season, gameweek, count(DISTINCT fixture_id) AS matches, min(cutoff) - 5400000000 AS deadline, max(hist) AS hist_latest, round(min(cutoff - 5400000000 - hist) / 3600e6, 6) AS margin_hours FROM o GROUP BY ALL""")
def a23(spark, sf):
    from kickline.plans.form import objectives
    long = silver.team_match(spark, sf)
    seen = asof_attach(objectives(long), ["team"], "cutoff", [History(long, "kick", [], used_time="hist")])
    per = seen.groupBy("season", "gameweek", "fixture_id").agg(F.max("hist").alias("hist"), F.min("cutoff").alias("cutoff"))
    return per.groupBy("season", "gameweek").agg(
        F.count(F.lit(1)).alias("matches"), (F.min("cutoff") - cal.DEADLINE_OFFSET_US).alias("deadline"),
        F.max("hist").alias("hist_latest"),
        F.round(F.min(F.col("cutoff") - cal.DEADLINE_OFFSET_US - F.col("hist")) / 3_600_000_000, 6).alias("margin_hours"))


@query("a24_rows_available_per_deadline", """WITH d AS (SELECT season, gameweek, cutoff - 5400000000 AS deadline FROM fx_cut), s AS (SELECT kick FROM fx_player), n AS (SELECT count(*) AS total FROM s),
    c AS (SELECT kick, count(*) AS k FROM s GROUP BY kick), cum AS (SELECT kick, sum(k) OVER (ORDER BY kick) AS seen FROM c)
    SELECT d.season, d.gameweek, d.deadline, CAST(coalesce(cum.seen, 0) AS BIGINT) AS n_available, CAST(n.total - coalesce(cum.seen, 0) AS BIGINT) AS n_later FROM d ASOF LEFT JOIN cum ON d.deadline > cum.kick, n""")
def a24(spark, sf):
    d = cal.deadlines(silver.match(spark, sf), "kick").select("season", "gameweek", "deadline")
    from kickline.operators.checks import rows_available
    return rows_available(silver.player(spark, sf), "kick", d, "deadline")


@query("a25_modal_name_consistency", """WITH c AS (SELECT season, away_id, home, count(*) AS k FROM fx_match GROUP BY ALL), m AS (SELECT season, away_id, arg_max(home, (k, home)) AS modal FROM c GROUP BY ALL)
    SELECT away_id, count(DISTINCT modal) AS n_names, count(*) AS n_seasons FROM m GROUP BY away_id""")
def a25(spark, sf):
    c = silver.match(spark, sf).groupBy("season", "away_id", "home").agg(F.count(F.lit(1)).alias("k"))
    modal = c.groupBy("season", "away_id").agg(F.max_by("home", F.struct("k", "home")).alias("modal"))
    return modal.groupBy("away_id").agg(F.countDistinct("modal").alias("n_names"), F.count(F.lit(1)).alias("n_seasons"))


@query("a26_zero_share", """WITH t AS (SELECT season, gameweek, team, sum(xg) AS xg FROM fx_player GROUP BY ALL) SELECT season, round(avg(CASE WHEN xg = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM t GROUP BY season""")
def a26(spark, sf):
    t = silver.player(spark, sf).groupBy("season", "gameweek", "team").agg(F.sum("xg").alias("xg"))
    return t.groupBy("season").agg(F.round(F.avg((F.col("xg") == 0).cast("double")), 6).alias("zero_share"))


_COMPS = ("premier", "facup", "eflcup", "champions", "europa")


@query("a27_season_by_competition", "SELECT season, " + ", ".join(f"count(*) FILTER (WHERE competition = '{c}') AS {c}" for c in _COMPS) + " FROM fx_comp WHERE finished GROUP BY season")
def a27(spark, sf):
    g = silver.competition_match(spark, sf).filter("finished")
    return g.groupBy("season").pivot("competition", list(_COMPS)).count().fillna(0)


@query("a28_share_by_suffix", r"""SELECT regexp_extract(p_name, ' (\w+)$', 1) AS suffix, round(sum(p_retailprice), 4) AS total, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS share FROM part GROUP BY 1""")
def a28(spark, sf):
    p = silver.table(spark, sf, "part").withColumn("suffix", F.regexp_extract("p_name", r" (\w+)$", 1))
    return share_by(p, "suffix", "p_retailprice").select("suffix", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


@query("a29_mean_and_deviation", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY event_type")
def a29(spark, sf):
    return (silver.table(spark, sf, "events").groupBy("event_type")
            .agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count(F.lit(1)).alias("n")))


@query("a30_observations_per_parameter", """WITH s AS (SELECT season, count(*) AS n FROM fx_match GROUP BY season) SELECT season, n, k AS n_features, 2 * (k + 1) AS n_params, round(n / (2 * (k + 1)), 6) AS per_param,
    round(1.96 * sqrt(0.25 / n), 6) AS half_width, CASE WHEN n / (2 * (k + 1)) > 20 THEN 'ample' WHEN n / (2 * (k + 1)) > 10 THEN 'enough' ELSE 'tight' END AS verdict FROM s, (VALUES (10), (20), (30), (50)) v(k)""")
def a30(spark, sf):
    n = silver.match(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    df = n.select("season", "n", F.explode(F.array(*[F.lit(k) for k in (10, 20, 30, 50)])).alias("n_features"))
    df = df.withColumn("n_params", 2 * (F.col("n_features") + 1))
    per = F.col("n") / F.col("n_params")
    return df.withColumns({"per_param": F.round(per, 6), "half_width": F.round(1.96 * F.sqrt(0.25 / F.col("n")), 6),
                           "verdict": F.when(per > 20, "ample").when(per > 10, "enough").otherwise("tight")})


@query("a31_season_breakdown_with_total", f"""WITH {VERSUS_SQL}, x AS (SELECT CAST(season AS VARCHAR) AS season, result = 'draw' AS pos, m_draw AS s FROM vs UNION ALL SELECT 'ALL', result = 'draw', m_draw FROM vs),
    r AS (SELECT season, pos, rank() OVER (PARTITION BY season ORDER BY s) + (count(*) OVER (PARTITION BY season, s) - 1) / 2.0 AS rk FROM x)
    SELECT season, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc_draw FROM r GROUP BY season""")
def a31(spark, sf):
    v = versus(spark, sf).select(F.explode(F.array(F.col("season").cast("string"), F.lit("ALL"))).alias("season"), "result", "m_draw")
    out = auc(v, ["season"], "m_draw", F.col("result") == "draw")
    return out.select("season", "n_pos", "n_neg", F.round("auc", 6).alias("auc_draw"))
