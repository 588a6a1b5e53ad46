"""Interval, lookback, coverage, lookup and outer joins (J-04 to J-19)."""

from pyspark.sql import functions as F

from kickline.functions import text
from kickline.operators import joins as jn
from kickline.operators.calendar import cutoff_per_gameweek
from kickline.operators.intervals import valid_at, validity
from kickline.operators.reshape import two_sides
from kickline.operators.scoring import argmax_class, probs
from kickline.plans import form
from kickline.plans.competitions import competition_load
from kickline.queries.base import DAY, query
from kickline.queries.windows import rounded
from kickline.sources import silver

_VALID = """v AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY player_id ORDER BY day, valuation_id), 9e18::BIGINT) AS until FROM fx_valuation),
    cut AS (SELECT DISTINCT cutoff FROM fx_cut), hit AS (SELECT cutoff, club, line, value, row_number() OVER (PARTITION BY cutoff, club ORDER BY value DESC, valuation_id) AS rn
      FROM v JOIN cut ON v.day <= cut.cutoff AND cut.cutoff < v.until)"""


@query("j04_interval_join_values", f"""WITH {_VALID}, agg AS (SELECT cutoff, club, CAST(sum(value) AS BIGINT) AS squad_value, count(*) AS n_valid, CAST(sum(value) FILTER (WHERE rn <= 11) AS BIGINT) AS top11
      FROM hit GROUP BY ALL) SELECT *, round(squad_value / sum(squad_value) OVER (PARTITION BY cutoff), 9) AS value_share FROM agg""")
def j04(spark, sf):
    v = validity(silver.valuation(spark, sf), ["player_id"], "day", "valuation_id")
    cut = silver.cutoffs(spark, sf).select("cutoff")
    per_club = valid_at(v, ["club"], cut, "cutoff", "value", {"squad_value": F.col("value")}, top_n=11)
    total = per_club.groupBy("cutoff").agg(F.sum("squad_value").alias("_t"))
    return (per_club.join(total, "cutoff")
            .select("cutoff", "club", "squad_value", "n_valid", "top11",
                    F.round(F.col("squad_value") / F.col("_t"), 9).alias("value_share")))


@query("j05_lookback_all_competitions", f"""WITH h AS (SELECT *, CASE WHEN gf > gc THEN 3 WHEN gf = gc THEN 1 ELSE 0 END AS pts FROM fx_comp WHERE finished),
    f AS (SELECT team, kick, avg(pts) OVER w AS pts, avg(gf) OVER w AS gf, avg(gc) OVER w AS gc FROM h WINDOW w AS (PARTITION BY team ORDER BY kick, event_id ROWS 4 PRECEDING)),
    c AS (SELECT o.team, o.cutoff, o.season, {", ".join(f"count(h.kick) FILTER (WHERE h.kick >= o.cutoff - {n * DAY}) AS games_all_{n}d" for n in (7, 14, 21))},
      {", ".join(f"count(h.kick) FILTER (WHERE h.kick >= o.cutoff - {n * DAY} AND h.competition <> 'premier') AS games_cup_{n}d" for n in (7, 14))},
      count(h.kick) FILTER (WHERE h.season = o.season AND h.competition IN ('eflcup', 'facup')) AS cup_games,
      count(h.kick) FILTER (WHERE h.season = o.season AND h.competition IN ('champions', 'europa')) AS europe_games,
      CASE WHEN count(h.kick) > 0 THEN coalesce(max(h.round_weight) FILTER (WHERE h.season = o.season AND h.competition <> 'premier'), 0) END AS round_max,
      max(h.kick) AS last FROM fx_compobj o LEFT JOIN h ON h.team = o.team AND h.kick < o.cutoff GROUP BY ALL)
    SELECT c.* EXCLUDE (last), round((c.cutoff - c.last) / {DAY}, 6) AS days_since_last, round(f.pts, 6) AS pts_all_u5, round(f.gf, 6) AS gf_all_u5, round(f.gc, 6) AS gc_all_u5
    FROM c ASOF LEFT JOIN f ON f.team = c.team AND c.cutoff > f.kick""")
def j05(spark, sf):
    df = competition_load(silver.competition_objectives(spark, sf), silver.competition_match(spark, sf), [])
    return rounded(df, "days_since_last", "pts_all_u5", "gf_all_u5", "gc_all_u5")


@query("j06_checked_inner_join", "SELECT season, fixture_id, home, away, gameweek, kick FROM fx_match")
def j06(spark, sf):
    m = silver.match(spark, sf)
    key = ["season", "match_date", "home", "away", "fixture_id"]
    fixtures = m.select(*key, "gameweek", "kick")
    joined = jn.checked_join(m.select(*key), fixtures, key, one_to_one=True, keep_all=True)
    return joined.select("season", "fixture_id", "home", "away", "gameweek", "kick")


@query("j07_left_join_player_stats", """WITH s AS (SELECT season, fixture_id, team, sum(xg) AS xg, count(*) FILTER (WHERE minutes > 0) AS n_players FROM fx_player GROUP BY ALL)
    SELECT l.season, l.fixture_id, l.team, l.gf, round(s.xg, 6) AS xg, s.n_players FROM fx_long l LEFT JOIN s USING (season, fixture_id, team)""")
def j07(spark, sf):
    stats = (silver.player(spark, sf).groupBy("season", "fixture_id", "team")
             .agg(F.round(F.sum("xg"), 6).alias("xg"), F.count_if(F.col("minutes") > 0).alias("n_players")))
    return (silver.team_match(spark, sf).select("season", "fixture_id", "team", "gf")
            .join(stats, ["season", "fixture_id", "team"], "left"))


@query("j08_opponent_value", """WITH s AS (SELECT season, fixture_id, team, sum(xg) AS xg FROM fx_player GROUP BY ALL)
    SELECT a.season, a.fixture_id, a.team, round(a.xg, 6) AS xg, round(b.xg, 6) AS xgc FROM s a LEFT JOIN s b ON a.season = b.season AND a.fixture_id = b.fixture_id AND a.team <> b.team""")
def j08(spark, sf):
    s = silver.player(spark, sf).groupBy("season", "fixture_id", "team").agg(F.sum("xg").alias("xg"))
    return rounded(jn.opponent_value(s, ["season", "fixture_id"], "team", {"xgc": "xg"}), "xg", "xgc")


@query("j09_played_semi_anti", "SELECT season, fixture_id, kick < epoch_us(TIMESTAMP '2001-07-01') AS played FROM fx_match")
def j09(spark, sf):
    m = silver.match(spark, sf)
    results = m.filter(F.col("kick") < played_until()).select("season", "match_date", "home", "away", "fixture_id").distinct()
    key = ["season", "match_date", "home", "away", "fixture_id"]
    return (m.select(*key).join(results.withColumn("_hit", F.lit(True)), key, "left")
            .select("season", "fixture_id", F.coalesce("_hit", F.lit(False)).alias("played")))


def played_until() -> int:
    """The clock of the inference path: 2001-07-01 UTC, in microseconds."""
    import datetime as dt
    return int(dt.datetime(2001, 7, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


@query("j10_coverage_rate", """SELECT season, count(*) AS n, count(s.fixture_id) AS matched, round(count(s.fixture_id) / count(*), 6) AS rate
    FROM fx_long l LEFT JOIN (SELECT DISTINCT season, fixture_id, team FROM fx_player) s USING (season, fixture_id, team) GROUP BY season""")
def j10(spark, sf):
    key = ["season", "fixture_id", "team"]
    return rounded(jn.coverage(silver.team_match(spark, sf).select(*key), silver.player(spark, sf).select(*key), key, ["season"]), "rate")


@query("j11_fill_missing_gameweeks", """WITH p AS (SELECT season, gameweek, fixture_id, player, points, 'settled' AS src FROM fx_player WHERE gameweek % 4 <> 0),
    live AS (SELECT season, gameweek, fixture_id, player, points, 'live' AS src FROM fx_player WHERE gameweek % 4 <> 1)
    SELECT src, season, gameweek, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM (SELECT * FROM p UNION ALL
      SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.season = l.season AND p.gameweek = l.gameweek)) GROUP BY ALL""")
def j11(spark, sf):
    p = silver.player(spark, sf).select("season", "gameweek", "fixture_id", "player", "points")
    settled = p.filter(F.col("gameweek") % 4 != 0).withColumn("src", F.lit("settled"))
    live = p.filter(F.col("gameweek") % 4 != 1).withColumn("src", F.lit("live"))
    return (jn.fill_gaps(settled, live, ["season", "gameweek"]).groupBy("src", "season", "gameweek")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points")))


@query("j12_dimension_lookup", "SELECT c_custkey AS id, n_name AS team FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j12(spark, sf):
    dim = silver.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team"))
    return (silver.table(spark, sf, "customer").join(jn.sized_broadcast(dim), "c_nationkey", "left")
            .select(F.col("c_custkey").alias("id"), "team"))


@query("j13_composite_key_lookup", """WITH codes AS (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY team) AS code FROM (SELECT DISTINCT season, team FROM fx_long))
    SELECT m.season, m.fixture_id, CAST(h.code AS INT) AS home_code, CAST(a.code AS INT) AS away_code FROM fx_match m LEFT JOIN codes h ON h.season = m.season AND h.team = m.home LEFT JOIN codes a ON a.season = m.season AND a.team = m.away""")
def j13(spark, sf):
    from pyspark.sql import Window
    m = silver.match(spark, sf)
    teams = silver.team_match(spark, sf).select("season", "team").distinct()
    codes = teams.withColumn("code", F.row_number().over(Window.partitionBy("season").orderBy("team")))
    codes = jn.sized_broadcast(codes)
    home = codes.select("season", F.col("team").alias("home"), F.col("code").alias("home_code"))
    away = codes.select("season", F.col("team").alias("away"), F.col("code").alias("away_code"))
    return (m.select("season", "fixture_id", "home", "away").join(home, ["season", "home"], "left")
            .join(away, ["season", "away"], "left").select("season", "fixture_id", "home_code", "away_code"))


@query("j14_rank_many_to_one", """WITH camp AS (SELECT season, team, kick, sum(pts) OVER w AS pts, sum(gd) OVER w AS gd, sum(gf) OVER w AS gf FROM fx_long
      WINDOW w AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT season, gameweek, cutoff, team FROM fx_cut JOIN (SELECT DISTINCT season, team FROM fx_long) USING (season)),
    t AS (SELECT g.season, g.gameweek, g.team, CAST(row_number() OVER (PARTITION BY g.season, g.cutoff ORDER BY coalesce(pts, 0) DESC, coalesce(gd, 0) DESC, coalesce(gf, 0) DESC, g.team) AS INT) AS pos
      FROM g ASOF LEFT JOIN camp c ON g.season = c.season AND g.team = c.team AND g.cutoff > c.kick)
    SELECT m.season, m.fixture_id, h.pos AS home_position, a.pos AS away_position FROM fx_match m LEFT JOIN t h ON h.season = m.season AND h.gameweek = m.gameweek AND h.team = m.home
    LEFT JOIN t a ON a.season = m.season AND a.gameweek = m.gameweek AND a.team = m.away""")
def j14(spark, sf):
    m = silver.match(spark, sf).select("season", "gameweek", "fixture_id", "home", "away")
    table = jn.sized_broadcast(form.league_table(silver.team_match(spark, sf)).select("season", "gameweek", "team", "position"))
    for side in ("home", "away"):
        ranks = table.select("season", "gameweek", F.col("team").alias(side), F.col("position").alias(f"{side}_position"))
        m = m.join(ranks, ["season", "gameweek", side], "left")
    return m.select("season", "fixture_id", "home_position", "away_position")


@query("j15_full_outer_ratings", """WITH a AS (SELECT home_id AS id, count(*) AS home_games FROM fx_match GROUP BY home_id), b AS (SELECT away_id AS id, count(*) AS away_games, sum(away_goals)::BIGINT AS goals FROM fx_match GROUP BY away_id)
    SELECT id, home_games, away_games, goals FROM a FULL JOIN b USING (id)""")
def j15(spark, sf):
    """Numbers of the two kinds of ids, which overlap in part only."""
    m = silver.match(spark, sf)
    a = m.groupBy(F.col("home_id").alias("id")).agg(F.count(F.lit(1)).alias("home_games"))
    b = m.groupBy(F.col("away_id").alias("id")).agg(F.count(F.lit(1)).alias("away_games"), F.sum("away_goals").alias("goals"))
    return a.join(b, "id", "full")


_LABEL = "CASE WHEN {p}_away >= {p}_draw AND {p}_away >= {p}_home THEN 'away' WHEN {p}_draw >= {p}_home THEN 'draw' ELSE 'home' END"


@query("j16_results_on_forecasts", f"""SELECT f.season, f.fixture_id, f.model, f.predicted_at, {_LABEL.format(p="p")} AS label, r.result,
    CASE WHEN r.result IS NOT NULL THEN {_LABEL.format(p="p")} = r.result END AS hit FROM fx_emitted f
    LEFT JOIN (SELECT season, fixture_id, result FROM fx_match WHERE kick < epoch_us(TIMESTAMP '2001-07-01')) r USING (season, fixture_id)""")
def j16(spark, sf):
    from kickline.sources.registry import with_results
    results = silver.match(spark, sf).filter(F.col("kick") < played_until()).select("season", "fixture_id", "result")
    labelled = silver.emissions(spark, sf).withColumn("label", argmax_class(*probs("p")))
    return with_results(labelled, results, "label").select("season", "fixture_id", "model", "predicted_at", "label", "result", "hit")


@query("j17_complete_gameweeks_gate", f"""WITH d AS (SELECT f.season, f.gameweek, {_LABEL.format(p="p")} AS label, r.result FROM fx_pred f
      LEFT JOIN (SELECT season, fixture_id, result FROM fx_match WHERE kick < epoch_us(TIMESTAMP '2001-07-03') OR fixture_id % 3 = 0) r USING (season, fixture_id))
    SELECT season, gameweek, count(*) AS n, round(avg(CASE WHEN label = result THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d GROUP BY ALL HAVING count(*) = count(result)""")
def j17(spark, sf):
    until = played_until() + 2 * DAY
    results = (silver.match(spark, sf).filter((F.col("kick") < until) | (F.col("fixture_id") % 3 == 0))
               .select("season", "fixture_id", F.col("result").alias("actual")))
    d = (silver.forecast(spark, sf).withColumn("label", argmax_class(*probs("p")))
         .select("season", "gameweek", "fixture_id", "label").join(results, ["season", "fixture_id"], "left"))
    return (d.groupBy("season", "gameweek")
            .agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("_known"),
                 F.round(F.avg((F.col("label") == F.col("actual")).cast("double")), 6).alias("accuracy"))
            .filter(F.col("n") == F.col("_known")).drop("_known"))


@query("j18_threshold_grid", """WITH t AS (SELECT unnest([0.50, 0.40, 0.35, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.20]::DOUBLE[]) AS threshold)
    SELECT threshold, season, count(*) FILTER (WHERE p_draw >= threshold) AS n_draws, count(*) AS n FROM fx_pred, t GROUP BY ALL""")
def j18(spark, sf):
    from kickline.operators.decision import SWEEP_THRESHOLDS
    grid = F.explode(F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS])).alias("threshold")
    return (silver.forecast(spark, sf).select("season", "p_draw", grid).groupBy("threshold", "season")
            .agg(F.count_if(F.col("p_draw") >= F.col("threshold")).alias("n_draws"), F.count(F.lit(1)).alias("n")))


_NORM = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(lower(trim({c})), '''', ''), '.', ''), '-', ' '), '\butd\b', 'united', 'g'), '\s+', ' ', 'g'))"""
_STRIP = r"""regexp_replace({c}, '^(.*?\S)(?: (?:city|town|fc|afc))+$', '\1')"""
RESOLVE_SQL = f"""n AS (SELECT DISTINCT raw_name, {_NORM.format(c="raw_name")} AS norm FROM fx_names),
    reg AS (SELECT short_name, {_NORM.format(c="team_name")} AS norm FROM fx_clubs UNION SELECT short_name, lower(short_name) FROM fx_clubs),
    stripped AS (SELECT {_STRIP.format(c=_NORM.format(c="team_name"))} AS norm, min(short_name) AS short_name, count(*) AS k FROM fx_clubs GROUP BY 1),
    res AS (SELECT n.raw_name, n.norm, coalesce(CASE WHEN n.raw_name = 'The NATION 4' THEN 'T4' END, reg.short_name, CASE WHEN s.k = 1 THEN s.short_name END) AS short_name,
      CASE WHEN n.raw_name = 'The NATION 4' THEN 'alias' WHEN reg.short_name IS NOT NULL THEN 'exact' WHEN s.k = 1 THEN 'stripped' WHEN s.k > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how
      FROM n LEFT JOIN reg ON reg.norm = n.norm LEFT JOIN stripped s ON s.norm = {_STRIP.format(c="n.norm")})"""


@query("j19_name_bridge", f"""WITH {RESOLVE_SQL} SELECT f.raw_id, f.raw_name, res.short_name FROM fx_names f LEFT JOIN res USING (raw_name)""")
def j19(spark, sf):
    raw = silver.names(spark, sf)
    found = text.resolve_names(raw.select("raw_name").distinct(), silver.name_registry(spark, sf), ALIASES)
    bridge = found.select("raw_name", "short_name")
    return raw.join(jn.sized_broadcast(bridge), "raw_name", "left").select("raw_id", "raw_name", "short_name")


ALIASES = {"The NATION 4": "T4"}
