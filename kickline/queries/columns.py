"""Projections, filters and reshaping (P-*), and scalar functions (F-*)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kickline.functions import dates, goals, market, text
from kickline.operators import coldstart as cold
from kickline.operators.asof import History, asof_attach
from kickline.operators.checks import BANNED_COLUMNS
from kickline.operators.joins import checked_join
from kickline.operators.quantiles import exact_percentiles
from kickline.operators.reshape import differentials, outcome, points, two_sides, widen
from kickline.operators.scoring import CLASSES, decode, encode
from kickline.plans import form
from kickline.plans import training_rows as tr
from kickline.queries.aggregates import versus
from kickline.queries.base import DAY, query
from kickline.queries.joins import ALIASES, RESOLVE_SQL, played_until
from kickline.queries.windows import ORDER, rounded
from kickline.sources import silver
from kickline.sources.rename import RESULT_CODES, present_only, recode

NOW = "epoch_us(TIMESTAMP '2001-07-01')"


@query("p01_rename_present_only", "SELECT o_orderkey AS fixture_id, o_orderpriority AS round, o_totalprice AS value FROM orders")
def p01(spark, sf):
    return present_only(silver.table(spark, sf, "orders"), {
        "o_orderkey": "fixture_id", "o_orderpriority": "round", "o_totalprice": "value", "o_comment": "note"})


@query("p02_recode_by_dictionary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders")
def p02(spark, sf):
    return silver.table(spark, sf, "orders").select(
        "o_orderkey", recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("p03_allowed_positions", "SELECT position, count(*) AS n FROM fx_player WHERE position IN ('DEF', 'MID', 'FWD') GROUP BY position")
def p03(spark, sf):
    return (silver.player(spark, sf).filter(F.col("position").isin("DEF", "MID", "FWD"))
            .groupBy("position").agg(F.count(F.lit(1)).alias("n")))


@query("p04_drop_leaky_columns", "SELECT season, fixture_id, player, minutes FROM (SELECT season, fixture_id, player, minutes, points AS total_points, saves AS bonus FROM fx_player)")
def p04(spark, sf):
    p = silver.player(spark, sf).select("season", "fixture_id", "player", "minutes",
                                        F.col("points").alias("total_points"), F.col("saves").alias("bonus"))
    return p.drop(*BANNED_COLUMNS)


@query("p05_match_to_two_sides", "SELECT season, fixture_id, is_home, team, rival, gf, gc, shots, cards FROM fx_long")
def p05(spark, sf):
    return silver.team_match(spark, sf).select("season", "fixture_id", "is_home", "team", "rival", "gf", "gc", "shots", "cards")


@query("p06_points_and_goal_difference", "SELECT season, fixture_id, team, CAST(pts AS BIGINT) AS pts, gd FROM fx_long")
def p06(spark, sf):
    t = silver.team_match(spark, sf)
    return t.select("season", "fixture_id", "team", points("gf", "gc").cast("long").alias("pts"), (F.col("gf") - F.col("gc")).alias("gd"))


@query("p07_objectives_per_side", "SELECT season, fixture_id, team, is_home, cutoff FROM fx_obj")
def p07(spark, sf):
    m = silver.match(spark, sf).join(silver.cutoffs(spark, sf), ["season", "gameweek"])
    return two_sides(m, ["season", "fixture_id", "cutoff"], {"team": ("home", "away")})


@query("p08_sides_to_wide", """SELECT season, fixture_id, max(gf) FILTER (WHERE is_home) AS home_gf, max(gf) FILTER (WHERE NOT is_home) AS away_gf,
    max(shots) FILTER (WHERE is_home) AS home_shots, max(shots) FILTER (WHERE NOT is_home) AS away_shots FROM fx_long GROUP BY ALL""")
def p08(spark, sf):
    t = silver.team_match(spark, sf).withColumn("side", F.when(F.col("is_home"), "home").otherwise("away"))
    return widen(t, ["season", "fixture_id"], "side", ["gf", "shots"])


_REST = """WITH a AS (SELECT o.*, h.kick AS hist FROM fx_obj o ASOF LEFT JOIN (SELECT team, kick FROM fx_long) h ON h.team = o.team AND o.cutoff > h.kick)"""


@query("p10_rest_days", f"{_REST} SELECT season, fixture_id, team, round((kick - hist) / {DAY}, 6) AS rest_days FROM a")
def p10(spark, sf):
    long = silver.team_match(spark, sf)
    seen = asof_attach(form.objectives(long), ["team"], "cutoff", [History(long, "kick", [], used_time="hist")])
    return seen.select("season", "fixture_id", "team", F.round((F.col("kick") - F.col("hist")) / DAY, 6).alias("rest_days"))


@query("p11_difficulty", "SELECT season, fixture_id, fdr_home, fdr_away, fdr_home - fdr_away AS fdr_dif FROM fx_match")
def p11(spark, sf):
    m = silver.match(spark, sf)
    fdr = m.select("season", "fixture_id", "fdr_home", "fdr_away")
    return (checked_join(m.select("season", "fixture_id"), fdr, ["season", "fixture_id"], one_to_one=True)
            .withColumn("fdr_dif", F.col("fdr_home") - F.col("fdr_away")))


@query("p12_differentials", """SELECT season, fixture_id, home_shots - away_shots AS dif_shots, home_sot - away_sot AS dif_sot, home_corners - away_corners AS dif_corners FROM fx_match""")
def p12(spark, sf):
    names = ["shots", "sot", "corners"]
    return differentials(silver.match(spark, sf), names).select("season", "fixture_id", *[f"dif_{n}" for n in names])


@query("p13_target_where_played", f"SELECT season, fixture_id, CASE WHEN kick < {NOW} THEN result END AS target FROM fx_match")
def p13(spark, sf):
    played = F.col("kick") < played_until()
    m = silver.match(spark, sf).withColumns({c: F.when(played, F.col(c)) for c in ("home_goals", "away_goals")})
    return m.select("season", "fixture_id", outcome("home_goals", "away_goals").alias("target"))


SPLIT_SQL = f"CASE WHEN kick >= {NOW} THEN 'inference' WHEN season = 2000 THEN 'holdout' WHEN season < 2000 THEN 'train' ELSE 'current' END"


def with_split(spark, sf):
    m = silver.match(spark, sf).withColumn("target", F.when(F.col("kick") < played_until(), F.col("result")))
    return m.withColumn("split", tr.split_label("target", "season", 2000, list(range(1990, 2000))))


@query("p14_split_label", f"SELECT season, {SPLIT_SQL} AS split, count(*) AS n FROM fx_match GROUP BY ALL")
def p14(spark, sf):
    return with_split(spark, sf).groupBy("season", "split").agg(F.count(F.lit(1)).alias("n"))


@query("p17_season_start_fixup", """WITH camp AS (SELECT season, team, kick, sum(pts) OVER w AS pts, count(*) OVER w AS played FROM fx_long WINDOW w AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING))
    SELECT o.season, o.fixture_id, o.team, CAST(coalesce(c.pts, 0) AS BIGINT) AS pts_camp, coalesce(c.played, 0) AS played_camp, round(CASE WHEN c.played > 0 THEN c.pts / c.played END, 6) AS ppg_camp
    FROM fx_obj o ASOF LEFT JOIN camp c ON c.season = o.season AND c.team = o.team AND o.cutoff > c.kick""")
def p17(spark, sf):
    long = silver.team_match(spark, sf)
    seen = asof_attach(form.objectives(long), ["season", "team"], "cutoff",
                       [History(form.championship(long), "kick", ["pts_camp", "played_camp", "ppg_camp"], tie="fixture_id")])
    fixed = tr.season_start(seen, totals=["pts_camp", "played_camp"], undefined=["ppg_camp"], played="played_camp")
    return rounded(fixed.select("season", "fixture_id", "team", "pts_camp", "played_camp", "ppg_camp"), "ppg_camp")


@query("p18_training_row_variants", " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) AS n FROM fx_match WHERE kick < {NOW} AND {c}" for n, c in (
    ("all", "true"), ("from_gw6", "gameweek >= 6"), ("with_odds", "odds_home IS NOT NULL"), ("no_last_gw", "gameweek < 53"))))
def p18(spark, sf):
    m = with_split(spark, sf)
    return tr.count_variants(m, tr.row_variants(first_gameweek=6, last_gameweek=53))


@query("p19_subgroups", """SELECT sub AS subgroup, count(*) AS n, round(avg(CASE WHEN result = 'home' THEN 1.0 ELSE 0.0 END), 6) AS home_rate FROM (
    SELECT 'early' AS sub, result FROM fx_match WHERE gameweek <= 5 UNION ALL SELECT 'rest', result FROM fx_match WHERE gameweek > 5 UNION ALL SELECT 'easy_home', result FROM fx_match WHERE fdr_home <= 2) GROUP BY sub""")
def p19(spark, sf):
    groups = {"early": F.col("gameweek") <= 5, "rest": F.col("gameweek") > 5, "easy_home": F.col("fdr_home") <= 2}
    return (tr.by_subgroup(silver.match(spark, sf).select("result", "gameweek", "fdr_home"), groups).groupBy("subgroup")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("result") == "home").cast("double")), 6).alias("home_rate")))


@query("p20_unpivot_classes", " UNION ALL ".join(f"SELECT season, fixture_id, '{c}' AS cls, round(p_{c}, 6) AS p, odds_{c} AS odds FROM fx_pred" for c in CLASSES))
def p20(spark, sf):
    f = silver.forecast(spark, sf)
    return f.select("season", "fixture_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.round(f"p_{c}", 6).alias("p"), F.col(f"odds_{c}").alias("odds")) for c in CLASSES])).alias("x")
    ).select("season", "fixture_id", "x.*")


@query("p21_season_labels", """SELECT DISTINCT season, CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label, season AS start_year,
    lpad(CAST(season % 100 AS VARCHAR), 2, '0') || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS url, CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS parsed FROM fx_match""")
def p21(spark, sf):
    s = silver.match(spark, sf).select("season").distinct()
    label = dates.season_label(F.col("season"))
    return s.select("season", label.alias("label"), dates.season_start(label).alias("start_year"), dates.season_url(label).alias("url"),
                    dates.season_from_text(F.concat(F.lit("League Season "), F.col("season"), F.lit("/"), F.col("season") + 1)).alias("parsed"))


@query("p22_feature_matrix", """SELECT season, fixture_id, 6 AS n_features, CAST(home_shots + 2 * away_shots + 3 * home_sot + 4 * away_sot + 5 * fdr_home + 6 * fdr_away AS DOUBLE) AS weighted FROM fx_match""")
def p22(spark, sf):
    feats = ["home_shots", "away_shots", "home_sot", "away_sot", "fdr_home", "fdr_away"]
    m = tr.feature_matrix(silver.match(spark, sf), feats, keep=["season", "fixture_id"])
    v = vector_to_array("features")
    weights = F.array(*[F.lit(float(i)) for i in range(1, len(feats) + 1)])
    dot = F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return m.select("season", "fixture_id", F.size(v).alias("n_features"), dot.alias("weighted"))


@query("p23_encode_decode", """SELECT result, CASE result WHEN 'away' THEN 0 WHEN 'draw' THEN 1 ELSE 2 END AS code, result AS back, count(*) AS n FROM fx_match GROUP BY ALL""")
def p23(spark, sf):
    code = encode(F.col("result"))
    return (silver.match(spark, sf).select("result", code.alias("code"), decode(code).alias("back"))
            .groupBy("result", "code", "back").agg(F.count(F.lit(1)).alias("n")))


@query("p24_capped_counters", """SELECT team, fixture_id, least(count(*) OVER (PARTITION BY team ORDER BY kick, fixture_id), 38) AS n_hist FROM fx_long""")
def p24(spark, sf):
    from kickline.operators.windows import running
    df = running(silver.team_match(spark, sf).select("team", "fixture_id", "kick"), ["team"], ORDER, ordinal="_n")
    return df.select("team", "fixture_id", F.least("_n", F.lit(tr.HISTORY_CAP)).alias("n_hist"))


# -- scalar functions ------------------------------------------------------------------------------

@query("f01_entity_resolution", f"WITH {RESOLVE_SQL} SELECT raw_name, norm, short_name, how FROM res")
def f01(spark, sf):
    return text.resolve_names(silver.names(spark, sf).select("raw_name").distinct(), silver.name_registry(spark, sf), ALIASES)


_NORM = r"trim(regexp_replace(regexp_replace(replace(replace(replace(lower(trim({c})), '''', ''), '.', ''), '-', ' '), '\butd\b', 'united', 'g'), '\s+', ' ', 'g'))"


@query("f02_normalize_name", f"SELECT raw_id, {_NORM.format(c='raw_name')} AS norm FROM fx_names")
def f02(spark, sf):
    return silver.names(spark, sf).select("raw_id", text.normalize(F.col("raw_name")).alias("norm"))


@query("f03_strip_generic_suffix", rf"""SELECT raw_id, regexp_replace({_NORM.format(c="raw_name || ' City Town AFC'")}, '^(.*?\S)(?: (?:city|town|fc|afc))+$', '\1') AS stripped FROM fx_names""")
def f03(spark, sf):
    name = F.concat(F.col("raw_name"), F.lit(" City Town AFC"))
    return silver.names(spark, sf).select("raw_id", text.strip_generic(text.normalize(name)).alias("stripped"))


@query("f04_resolve_many", "SELECT upper(team_name) AS raw_name, lower(team_name) AS norm, short_name, 'exact' AS how FROM fx_clubs")
def f04(spark, sf):
    """Every name of the registry resolves; unresolved ones would raise together."""
    reg = silver.name_registry(spark, sf)
    found = text.resolve_names(reg.select(F.upper("team_name").alias("raw_name")), reg)
    return text.require_resolved(found)


@query("f05_day_first_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def f05(spark, sf):
    o = silver.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (F.when(k % 7 == 0, F.lit("31/02/x")).when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
           .when(F.year("o_orderdate") >= 2000, F.date_format("o_orderdate", "dd/MM/yy"))
           .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    return o.select("o_orderkey", dates.parse_day_first(raw).cast("string").alias("day"))


@query("f06_london_calendar_day", "SELECT event_id, CAST(CAST(timezone('Europe/London', timezone('UTC', make_timestamp(kick))) AS DATE) AS VARCHAR) AS day FROM fx_comp")
def f06(spark, sf):
    ts = F.timestamp_micros("kick")
    c = silver.competition_match(spark, sf)
    return c.select("event_id", dates.london_day(ts).cast("string").alias("day"))


@query("f07_epoch_milliseconds", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS at_us FROM events")
def f07(spark, sf):
    ms = F.floor(F.col("kick") / 1000)
    return silver.competition_match(spark, sf).select("event_id", F.unix_micros(F.timestamp_millis(ms)).alias("at_us"))


@query("f08_text_to_number", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) END AS number FROM events")
def f08(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return silver.table(spark, sf, "events").select("event_id", F.round(raw.try_cast("double"), 6).alias("number"))


@query("f09_safe_ratio", "SELECT season, fixture_id, team, round(sot / nullif(shots, 0), 6) AS share FROM fx_long")
def f09(spark, sf):
    return silver.team_match(spark, sf).select("season", "fixture_id", "team", F.round(F.try_divide(F.col("sot"), F.col("shots")), 6).alias("share"))


@query("f10_round_importance", """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 6 WHEN 'signup' THEN 9 WHEN 'purchase' THEN 3 END AS importance FROM events""")
def f10(spark, sf):
    label = recode(F.col("event_type"), {"view": "1st Round", "click": "Round of 16", "signup": "Final", "purchase": "Group Stage", "error": "Replay"})
    from kickline.sources.rename import round_importance
    return silver.table(spark, sf, "events").select("event_id", round_importance(label).alias("importance"))


@query("f11_margin_free_probabilities", """SELECT season, fixture_id, round(1 / odds_home + 1 / odds_draw + 1 / odds_away, 6) AS overround, """ + ", ".join(
    f"round(1 / odds_{c} / (1 / odds_home + 1 / odds_draw + 1 / odds_away), 6) AS m_{c}" for c in CLASSES) + " FROM fx_match")
def f11(spark, sf):
    o = [F.col(f"odds_{c}") for c in ("home", "draw", "away")]
    return silver.match(spark, sf).select("season", "fixture_id", F.round(market.overround(*o), 6).alias("overround"),
                                          *[F.round(v, 6).alias(f"m_{k}") for k, v in market.implied(*o).items()])


@query("f12_choose_odds_by_coverage", "SELECT season, round(avg(odds_home), 6) AS mean_odds FROM fx_match GROUP BY season")
def f12(spark, sf):
    m = silver.match(spark, sf)
    thin = {f"thin_{c}": F.when(F.col("fixture_id") % 4 == 0, F.col(f"odds_{c}")) for c in CLASSES}
    triples = [tuple(f"thin_{c}" for c in ("home", "draw", "away")), tuple(f"odds_{c}" for c in ("home", "draw", "away"))]
    best = market.choose_odds(m.withColumns(thin), triples)
    return m.groupBy("season").agg(F.round(F.avg(best[0]), 6).alias("mean_odds"))


@query("f13_logistic_expectation", "SELECT season, fixture_id, round(1 / (1 + pow(10, ((1500 + away_shots * 10) - (1500 + home_shots * 10 + 65)) / 400.0)), 6) AS expected FROM fx_match")
def f13(spark, sf):
    a, b = 1565 + F.col("home_shots") * 10, 1500 + F.col("away_shots") * 10
    return silver.match(spark, sf).select("season", "fixture_id", F.round(market.logistic_expectation(a, b), 6).alias("expected"))


@query("f14_rating_goals_map", """SELECT season, fixture_id, round(sign(home_shots - 10) * (pow(10, abs(home_shots - 10) / 10.0) - 1), 6) AS goals, round(3 * log10(1 + abs(home_goals - away_goals)), 6) AS damped FROM fx_match""")
def f14(spark, sf):
    return silver.match(spark, sf).select(
        "season", "fixture_id", F.round(market.rating_to_goals((F.col("home_shots") - 10).cast("double")), 6).alias("goals"),
        F.round(market.damped_error(F.abs(F.col("home_goals") - F.col("away_goals"))), 6).alias("damped"))


_LAM = "exp(0.1 + home_shots / 40.0 - away_sot / 50.0 + 0.25)"
_MU = "exp(0.1 + away_shots / 40.0 - home_sot / 50.0)"


def rate_cols():
    return goals.rates(F.col("home_shots") / 40, F.col("home_sot") / 50, F.col("away_shots") / 40, F.col("away_sot") / 50, F.lit(0.1), 0.25)


@query("f15_poisson_rates", f"SELECT season, fixture_id, round({_LAM}, 6) AS lam, round({_MU}, 6) AS mu FROM fx_match")
def f15(spark, sf):
    lam, mu = rate_cols()
    return silver.match(spark, sf).select("season", "fixture_id", F.round(lam, 6).alias("lam"), F.round(mu, 6).alias("mu"))


_GRID = f"""WITH r AS (SELECT season, fixture_id, {_LAM} AS lam, {_MU} AS mu FROM fx_match),
    k AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS k), c AS (SELECT r.*, x.k AS x, y.k AS y, exp(-lam) * pow(lam, x.k) / factorial(x.k) * exp(-mu) * pow(mu, y.k) / factorial(y.k) AS p FROM r, k x, k y),
    t AS (SELECT *, greatest(p * CASE WHEN x = 0 AND y = 0 THEN 1 - lam * mu * {{rho}} WHEN x = 0 AND y = 1 THEN 1 + lam * {{rho}} WHEN x = 1 AND y = 0 THEN 1 + mu * {{rho}} WHEN x = 1 AND y = 1 THEN 1 - {{rho}} ELSE 1 END, 0) AS q FROM c)
    SELECT season, fixture_id, round(sum(q) FILTER (WHERE x < y) / sum(q), 6) AS p_away, round(sum(q) FILTER (WHERE x = y) / sum(q), 6) AS p_draw, round(sum(q) FILTER (WHERE x > y) / sum(q), 6) AS p_home FROM t GROUP BY season, fixture_id"""


def _grid(spark, sf, rho):
    lam, mu = rate_cols()
    df = silver.match(spark, sf).select("season", "fixture_id", lam.alias("lam"), mu.alias("mu"))
    df = goals.with_outcome_probs(df, "lam", "mu", rho)
    return df.select("season", "fixture_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CLASSES])


@query("f16_poisson_score_grid", _GRID.format(rho="0"))
def f16(spark, sf):
    return _grid(spark, sf, 0.0)


@query("f17_low_score_correction", _GRID.format(rho="(-0.13)"))
def f17(spark, sf):
    return _grid(spark, sf, -0.13)


@query("f18_style_matchups", """SELECT season, fixture_id, home_sot * away_fouls AS mu_attack_home, away_sot * home_fouls AS mu_attack_away, abs(home_corners - away_corners) AS asymmetry, CAST(NULL AS DOUBLE) AS mu_absent FROM fx_match""")
def f18(spark, sf):
    from kickline.plans.matchups import matchups
    pairs = {"mu_attack_home": ("home_sot", "away_fouls"), "mu_attack_away": ("away_sot", "home_fouls"), "mu_absent": ("home_offsides", "away_fouls")}
    return matchups(silver.match(spark, sf), pairs, {"asymmetry": ("home_corners", "away_corners")}).select(
        "season", "fixture_id", *pairs, "asymmetry")


@query("f19_exact_percentiles", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS top FROM events GROUP BY event_type""")
def f19(spark, sf):
    out = exact_percentiles(silver.table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "top": 1.0})
    return rounded(out, "p50", "p95", "top")


@query("f20_latency_text", """SELECT event_id, CASE WHEN regexp_full_match(latency, '[0-9.]+s') THEN round(TRY_CAST(replace(latency, 's', '') AS DOUBLE) * 1000, 6) END AS ms FROM fx_log""")
def f20(spark, sf):
    from kickline.plans.logs import latency_ms
    return silver.request_log(spark, sf).select("event_id", F.round(latency_ms(F.col("latency")), 6).alias("ms"))


_STAMP = "strftime(make_timestamp(predicted_at), '%Y%m%dT%H%M%SZ')"


@query("f21_registry_file_names", f"""SELECT DISTINCT CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS season, gameweek, {_STAMP} AS stamp, CAST(gameweek % 3 AS INT) AS tie_no FROM fx_emitted""")
def f21(spark, sf):
    from kickline.sources.registry import parse_file_name
    e = silver.emissions(spark, sf).select("season", "gameweek", "predicted_at").distinct()
    tie = F.when(F.col("gameweek") % 3 != 0, F.concat(F.lit("_"), (F.col("gameweek") % 3).cast("string"))).otherwise("")
    path = F.concat(F.lit("s3://bucket/forecasts/"), dates.season_label(F.col("season")), F.lit("_GW"), F.lpad(F.col("gameweek").cast("string"), 2, "0"),
                    F.lit("_"), F.date_format(F.timestamp_micros("predicted_at"), "yyyyMMdd'T'HHmmss'Z'"), tie, F.lit(".parquet"))
    return e.select(parse_file_name(path).alias("x")).select("x.*")


@query("f22_content_version", """SELECT season, 'v2.' || substr(sha1(string_agg(team, '|' ORDER BY team)), 1, 8) || '.' || CAST(count(*) AS VARCHAR) AS version FROM (SELECT DISTINCT season, team FROM fx_long) GROUP BY season""")
def f22(spark, sf):
    from kickline.plans.contract import version_column
    t = silver.team_match(spark, sf).select("season", "team").distinct()
    # one name per team of the season
    return t.groupBy("season").agg(F.sort_array(F.collect_list("team")).alias("names")).select("season", version_column(F.col("names")).alias("version"))


@query("f23_json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def f23(spark, sf):
    k = F.from_json("props", "k bigint").getField("k")
    return silver.table(spark, sf, "events").select("event_id", k.alias("k"))


_T = "pow(p_{c}, 1 / 1.5) / (pow(p_away, 1 / 1.5) + pow(p_draw, 1 / 1.5) + pow(p_home, 1 / 1.5))"


@query("f24_temperature_scaling", "SELECT season, fixture_id, " + ", ".join(f"round({_T.format(c=c)}, 6) AS t_{c}" for c in CLASSES) + " FROM fx_pred")
def f24(spark, sf):
    t = market.temper({c: F.col(f"p_{c}") for c in CLASSES}, 1.5)
    return silver.forecast(spark, sf).select("season", "fixture_id", *[F.round(v, 6).alias(f"t_{k}") for k, v in t.items()])


@query("f25_draw_prior_shift", """WITH b AS (SELECT avg(CASE WHEN result = 'draw' THEN 1.0 ELSE 0.0 END) - avg(p_draw) AS missing FROM fx_pred),
    s AS (SELECT season, fixture_id, least(greatest(p_draw + missing, 1e-9), 1) AS d, least(greatest(p_away * (1 - (p_draw + missing)) / (p_away + p_home), 1e-9), 1) AS a, least(greatest(p_home * (1 - (p_draw + missing)) / (p_away + p_home), 1e-9), 1) AS h FROM fx_pred, b)
    SELECT season, fixture_id, round(a / (a + d + h), 6) AS s_away, round(d / (a + d + h), 6) AS s_draw, round(h / (a + d + h), 6) AS s_home FROM s""")
def f25(spark, sf):
    f = silver.forecast(spark, sf)
    bias = f.agg((F.avg((F.col("result") == "draw").cast("double")) - F.avg("p_draw")).alias("missing"))
    f = f.crossJoin(F.broadcast(bias))   # one row
    s = market.shift_draw(F.col("p_away"), F.col("p_draw"), F.col("p_home"), F.col("missing"))
    return f.select("season", "fixture_id", *[F.round(v, 6).alias(f"s_{k}") for k, v in s.items()])


@query("f26_class_arrays", """SELECT season, fixture_id, round(list_max([p_away, p_draw, p_home]), 6) AS top, CAST(list_position(['away', 'draw', 'home'], result) AS INT) AS class_no, round([p_away, p_draw, p_home][list_position(['away', 'draw', 'home'], result)], 6) AS p_actual FROM fx_pred""")
def f26(spark, sf):
    ps = F.array(*[F.col(f"p_{c}") for c in CLASSES])
    no = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("result")).cast("int")
    return silver.forecast(spark, sf).select("season", "fixture_id", F.round(F.array_max(ps), 6).alias("top"), no.alias("class_no"),
                                             F.round(F.element_at(ps, no), 6).alias("p_actual"))
