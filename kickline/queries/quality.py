"""Sorts and top-k (O-*), set operations (U-*), gates (Q-*), registry and versions (V-*), logs (G-*)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickline.functions import text
from kickline.operators import checks as ck
from kickline.operators import coldstart as cold
from kickline.operators import compare as cmp
from kickline.operators import players as pl
from kickline.operators.asof import History, asof_attach
from kickline.operators.calendar import deadlines
from kickline.operators.constraints import Reference, Rule, violations
from kickline.operators.intervals import validity
from kickline.operators.joins import checked_join, duplicate_keys, fill_gaps, sized_broadcast
from kickline.operators.scoring import CLASSES, argmax_class, probs, unknown_labels
from kickline.operators.topk import best_point, last_per_group, most_confident, top_sum
from kickline.plans import contract, form, logs
from kickline.queries.aggregates import NOW
from kickline.queries.base import DAY, query
from kickline.queries.columns import SPLIT_SQL, with_split
from kickline.queries.joins import ALIASES, RESOLVE_SQL, _LABEL, played_until
from kickline.queries.scores import RULE, labelled
from kickline.queries.windows import rounded
from kickline.sources import registry as reg
from kickline.sources import silver
from kickline.session import scratch_path
from kickline.sources.versions import VersionedTable

P = _LABEL.format(p="p")


# -- sorts and top-k -------------------------------------------------------------------------------

@query("o02_first_rows_per_group", "SELECT season, fixture_id, team FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kick, fixture_id) AS rn FROM fx_long) WHERE rn <= 5")
def o02(spark, sf):
    t = silver.team_match(spark, sf).select("season", "fixture_id", "team", "kick")
    return cold.first_games(t, ["season", "team"], ["kick", "fixture_id"]).select("season", "fixture_id", "team")


@query("o03_last_row_per_group", "SELECT team, max(kick) AS kick, arg_max(fixture_id, kick) AS fixture_id, CAST(arg_max(pts, kick) AS BIGINT) AS pts FROM fx_long GROUP BY team")
def o03(spark, sf):
    t = silver.team_match(spark, sf).select("team", "kick", "fixture_id", "pts")
    return last_per_group(t, ["team"], ["kick", "fixture_id"])


@query("o04_largest_then_sum", "SELECT club, CAST(sum(value) AS BIGINT) AS top11 FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY value DESC) AS rn FROM fx_valuation) WHERE rn <= 11 GROUP BY club")
def o04(spark, sf):
    return top_sum(silver.valuation(spark, sf), ["club"], "value", 11, "top11")


@query("o07_top_features", "SELECT p_name AS feature, round(sum(p_retailprice), 4) AS importance FROM part GROUP BY p_name ORDER BY importance DESC, feature LIMIT 20")
def o07(spark, sf):
    g = silver.table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.round(F.sum("p_retailprice"), 4).alias("importance"))
    return g.orderBy(F.desc("importance"), "feature").limit(20)   # top-k report


@query("o08_best_grid_point", f"""WITH t AS (SELECT unnest([0.50, 0.40, 0.35, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.20]::DOUBLE[]) AS threshold),
    l AS (SELECT season, threshold, 1 - avg(CASE WHEN {RULE.format(t="threshold")} = result THEN 1.0 ELSE 0.0 END) AS loss FROM fx_pred, t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY loss, threshold) AS rn FROM l) SELECT season, threshold, round(loss, 6) AS loss FROM r WHERE rn = 1""")
def o08(spark, sf):
    from kickline.operators.decision import SWEEP_THRESHOLDS, draw_threshold
    x = silver.forecast(spark, sf).select("season", "result", "p_away", "p_draw", "p_home", F.explode(F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS])).alias("threshold"))
    hit = (draw_threshold(F.col("threshold"), *probs("p")) == F.col("result")).cast("double")
    loss = x.groupBy("season", "threshold").agg((1 - F.avg(hit)).alias("loss"))
    return rounded(best_point(loss, ["season"], ["threshold"], "loss"), "loss")


@query("o09_total_order_before_fold", "SELECT fixture_id, CAST(row_number() OVER (ORDER BY kick, division, home, fixture_id) AS BIGINT) AS position FROM fx_match")
def o09(spark, sf):
    from kickline.operators.windows import running
    m = silver.match(spark, sf).select("fixture_id", "kick", "division", "home").withColumn("_all", F.lit(1))
    return running(m, ["_all"], ["kick", "division", "home", "fixture_id"], ordinal="position").select("fixture_id", "position")


@query("o10_most_confident_share", f"""WITH c AS (SELECT greatest(p_away, p_draw, p_home) AS top, {P} = result AS hit FROM fx_pred), e AS (SELECT quantile_cont(top, 0.8) AS edge FROM c)
    SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM c, e WHERE top >= edge""")
def o10(spark, sf):
    c = labelled(spark, sf).select(F.greatest(*probs("p")).alias("top"), (F.col("said") == F.col("result")).cast("double").alias("hit"))
    return most_confident(c, "top", 0.2).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


# -- set operations --------------------------------------------------------------------------------

@query("u01_union_by_name", "SELECT 'order' AS src, o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT 'event', event_id, value, event_type FROM events")
def u01(spark, sf):
    a = silver.table(spark, sf, "orders").select(F.lit("order").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = silver.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.lit("event").alias("src"), F.col("value").alias("amount"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_key_preferring_union", """WITH s AS (SELECT season, gameweek, fixture_id, home_goals AS v, 'settled' AS src FROM fx_match WHERE season < 2000), l AS (SELECT season, gameweek, fixture_id, away_goals AS v, 'live' AS src FROM fx_match WHERE season > 1997)
    SELECT * FROM s UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.season = l.season AND s.gameweek = l.gameweek)""")
def u02(spark, sf):
    m = silver.match(spark, sf)
    s = m.filter(F.col("season") < 2000).select("season", "gameweek", "fixture_id", F.col("home_goals").alias("v"), F.lit("settled").alias("src"))
    l = m.filter(F.col("season") > 1997).select("season", "gameweek", "fixture_id", F.col("away_goals").alias("v"), F.lit("live").alias("src"))
    return fill_gaps(s, l, ["season", "gameweek"])


_DEDUPE = ["season", "player", "gameweek", "fixture_id"]
_FIRST = ["line_no", "part_no", "supp_no", "price"]


@query("u03_dedupe_keep_first", """SELECT season, player, gameweek, fixture_id, team, minutes, line_no, part_no FROM (SELECT *, row_number() OVER (PARTITION BY season, player, gameweek, fixture_id ORDER BY line_no, part_no, supp_no, price) AS rn FROM fx_player) WHERE rn = 1""")
def u03(spark, sf):
    p = silver.player(spark, sf).select(*_DEDUPE, "team", "minutes", *_FIRST)
    return pl.dedupe_keep_first(p, _DEDUPE, _FIRST).select(*_DEDUPE, "team", "minutes", "line_no", "part_no")


@query("u03_duplicate_report", "SELECT season, CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS n_dropped FROM (SELECT season, count(*) AS k FROM fx_player GROUP BY season, player, gameweek, fixture_id) GROUP BY season")
def u03b(spark, sf):
    return pl.duplicate_report(silver.player(spark, sf), _DEDUPE, ["season"])


@query("u04_one_row_per_player_gameweek", """SELECT season, gameweek, player, fixture_id, minutes FROM (SELECT *, row_number() OVER (PARTITION BY season, gameweek, player ORDER BY fixture_id, line_no, part_no, supp_no, price) AS rn FROM fx_player) WHERE rn = 1""")
def u04(spark, sf):
    p = silver.player(spark, sf).select("season", "gameweek", "player", "minutes", "fixture_id", *_FIRST)
    return pl.dedupe_keep_first(p, ["season", "gameweek", "player"], ["fixture_id", *_FIRST]).select("season", "gameweek", "player", "fixture_id", "minutes")


@query("u05_expected_minus_present", "SELECT c_custkey AS id FROM customer EXCEPT SELECT away_id FROM fx_match WHERE result = 'away'")
def u05(spark, sf):
    return (silver.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
            .exceptAll(silver.match(spark, sf).filter(F.col("result") == "away").select("away_id").distinct()).distinct())


@query("u06_union_of_ids", "SELECT season, home AS team FROM fx_match UNION SELECT season, away FROM fx_match")
def u06(spark, sf):
    m = silver.match(spark, sf)
    return m.select("season", F.explode(F.array("home", "away")).alias("team")).distinct()


@query("u07_history_without_overlap", """SELECT season, division, kick, home, away, home_goals, away_goals, src FROM (SELECT *, 'window' AS src FROM fx_match WHERE season >= 1999 UNION ALL
    SELECT *, 'history' FROM fx_match WHERE NOT (division = 'EUROPE' AND season IN (SELECT DISTINCT season FROM fx_match WHERE season >= 1999)))""")
def u07(spark, sf):
    from kickline.operators.ratings import with_history
    cols = ["season", "division", "kick", "home", "away", "home_goals", "away_goals"]
    m = silver.match(spark, sf).select(*cols)
    return with_history(m.filter(F.col("season") >= 1999), m, own_division="EUROPE")


@query("u08_schema_difference", """SELECT v.*, n.n_rows FROM (VALUES ('missing', 'target'), ('extra', 'wb_away'), ('extra', 'wb_draw'), ('extra', 'wb_home')) v(kind, column_name), (SELECT count(*) AS n_rows FROM fx_match) n""")
def u08(spark, sf):
    m = silver.match(spark, sf)
    missing, extra = ck.schema_difference(m, [c for c in m.columns if not c.startswith("wb_")] + ["target"])
    rows = [("missing", c) for c in missing] + [("extra", c) for c in extra]
    report = spark.createDataFrame(rows, "kind string, column_name string")
    return report.crossJoin(m.agg(F.count(F.lit(1)).alias("n_rows")))   # one row


# -- gates -----------------------------------------------------------------------------------------

@query("q01_rows_after_deadline", "SELECT p.season, p.gameweek, count(*) AS n_late FROM fx_player p JOIN (SELECT season, gameweek, cutoff + 259200000000 AS deadline FROM fx_cut) d USING (season, gameweek) WHERE p.kick >= d.deadline GROUP BY ALL")
def q01(spark, sf):
    d = silver.cutoffs(spark, sf).select("season", "gameweek", (F.col("cutoff") + 3 * DAY).alias("deadline"))
    late = ck.after_deadline(silver.player(spark, sf).select("season", "gameweek", "kick"), "kick", sized_broadcast(d), ["season", "gameweek"])
    return late.groupBy("season", "gameweek").agg(F.count(F.lit(1)).alias("n_late"))


@query("q02_gate_before_write", "SELECT count(*) AS n_checked FROM fx_obj")
def q02(spark, sf):
    long = silver.team_match(spark, sf)
    seen = asof_attach(form.objectives(long), ["team"], "cutoff", [History(long, "kick", [], used_time="hist")])
    ck.gate(seen.filter(F.col("hist") >= F.col("cutoff")), "history at or after the cut-off", ck.LeakageError)
    return seen.agg(F.count(F.lit(1)).alias("n_checked"))


@query("q03_banned_columns", "SELECT v.column_name, n.n_rows FROM (VALUES ('bonus'), ('total_points')) v(column_name), (SELECT count(bonus) AS n_rows FROM (SELECT saves AS bonus FROM fx_player)) n")
def q03(spark, sf):
    p = silver.player(spark, sf).select("season", F.col("points").alias("total_points"), F.col("saves").alias("bonus"))
    found = spark.createDataFrame([(c,) for c in ck.banned_columns(p)], "column_name string")
    return found.crossJoin(p.agg(F.count("bonus").alias("n_rows")))   # one row


_MOVED = "CASE WHEN fixture_id % 97 = 0 THEN cutoff - 400 * 86400000000 ELSE cutoff END"


@query("q04_history_before_cutoff", f"""WITH h AS (SELECT DISTINCT team, kick FROM fx_long), x AS (SELECT o.*, h.kick AS used FROM fx_obj o ASOF LEFT JOIN h ON o.team = h.team AND o.cutoff > h.kick)
    SELECT count(*) FILTER (WHERE is_home AND used >= {_MOVED}) AS home, count(*) FILTER (WHERE NOT is_home AND used >= {_MOVED}) AS away FROM x""")
def q04(spark, sf):
    """Some cut-offs are moved back after the history was attached; their rows must be found."""
    wide = form.recent_form(silver.team_match(spark, sf), ["pts"])
    moved = F.when(F.col("fixture_id") % 97 == 0, F.col("cutoff") - 400 * 86_400_000_000).otherwise(F.col("cutoff"))
    return ck.used_at_or_after(wide.withColumn("cutoff", moved), {"home": "home_hist_kick", "away": "away_hist_kick"}, "cutoff")


@query("q05_stale_history", f"""WITH a AS (SELECT o.season, o.fixture_id, o.team, o.cutoff, h.kick AS hist FROM (SELECT c.*, u.cutoff FROM fx_club c JOIN fx_cut u USING (season, gameweek)) o ASOF LEFT JOIN (SELECT team, kick FROM fx_club) h ON h.team = o.team AND o.cutoff > h.kick)
    SELECT season, fixture_id, team, CAST(floor((cutoff - hist) / {DAY}) AS BIGINT) AS age_days FROM a WHERE floor((cutoff - hist) / {DAY}) > 60""")
def q05(spark, sf):
    club = silver.club_match(spark, sf).select("season", "gameweek", "fixture_id", "team", "kick")
    obj = club.join(sized_broadcast(silver.cutoffs(spark, sf)), ["season", "gameweek"])
    seen = asof_attach(obj, ["team"], "cutoff", [History(club, "kick", [], used_time="hist", tie="fixture_id")])
    return ck.stale_rows(seen, ["hist"], "cutoff").select("season", "fixture_id", "team", "age_days")


@query("q06_key_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q06(spark, sf):
    return duplicate_keys(silver.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q07_join_cardinality", "SELECT m.season, m.fixture_id, c.cutoff FROM fx_match m JOIN fx_cut c USING (season, gameweek)")
def q07(spark, sf):
    m = silver.match(spark, sf).select("season", "gameweek", "fixture_id")
    return checked_join(m, silver.cutoffs(spark, sf), ["season", "gameweek"], keep_all=True).select("season", "fixture_id", "cutoff")


@query("q08_unmapped_entities", f"WITH {RESOLVE_SQL} SELECT res.raw_name, res.how, count(*) AS n_rows FROM fx_names f JOIN res USING (raw_name) WHERE res.short_name IS NULL GROUP BY ALL")
def q08(spark, sf):
    raw = silver.names(spark, sf)
    found = text.resolve_names(raw.select("raw_name").distinct(), silver.name_registry(spark, sf), ALIASES)
    return (raw.join(found.filter(F.col("short_name").isNull()), "raw_name").groupBy("raw_name", "how")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("q09_inference_coherence", f"""WITH s AS (SELECT season, gameweek, CASE WHEN kick < {NOW} THEN result END AS target, {SPLIT_SQL} AS split FROM fx_match)
    SELECT count(*) FILTER (WHERE split = 'inference' AND target IS NOT NULL) AS with_target, count(*) FILTER (WHERE split <> 'inference' AND target IS NULL) AS lost_target,
    count(*) FILTER (WHERE split = 'inference' AND season <> 2001) AS foreign_season, count(DISTINCT (season, gameweek)) FILTER (WHERE split = 'inference') AS inference_gameweeks FROM s""")
def q09(spark, sf):
    return ck.inference_coherence(with_split(spark, sf), "target", "split", 2001)


@query("q10_column_contract", "SELECT season, fixture_id, kick, home, away, result FROM fx_match")
def q10(spark, sf):
    cols = ["season", "fixture_id", "kick", "home", "away", "result"]
    return ck.require_contract(silver.match(spark, sf).select(*reversed(cols)), cols)


@query("q11_foreign_division", """SELECT season || '-' || home AS file, string_agg(DISTINCT division, ',' ORDER BY division) AS found, count(DISTINCT division) = 1 AND min(division) = 'EUROPE' AS ok FROM
    (SELECT season, home, CASE WHEN fixture_id % 101 = 0 THEN 'ASIA' ELSE division END AS division FROM fx_match) GROUP BY season, home""")
def q11(spark, sf):
    """One file per season and home side, with some rows of a foreign division slipped in."""
    m = silver.match(spark, sf).select(F.concat_ws("-", "season", "home").alias("file"), F.when(F.col("fixture_id") % 101 == 0, "ASIA").otherwise(F.col("division")).alias("division"))
    return ck.foreign_division(m, "file", "division", "EUROPE").withColumn("found", F.array_join("found", ","))


@query("q12_player_of_a_club_not_playing", """SELECT p.season, p.fixture_id, p.player, p.team FROM (SELECT season, fixture_id, player, CASE WHEN part_no % 23 = 0 THEN 'NATION_0' ELSE team END AS team FROM fx_player) p JOIN fx_match m USING (season, fixture_id) WHERE p.team <> m.home AND p.team <> m.away""")
def q12(spark, sf):
    moved = F.when(F.col("part_no") % 23 == 0, F.lit("NATION_0")).otherwise(F.col("team"))
    p = silver.player(spark, sf).select("season", "fixture_id", "player", moved.alias("team"))
    m = silver.match(spark, sf).select("season", "fixture_id", "home", "away")
    return p.join(m, ["season", "fixture_id"]).filter((F.col("team") != F.col("home")) & (F.col("team") != F.col("away"))).drop("home", "away")


def _q13_sql() -> str:
    """The problems as SQL works them out from the contract's names: the hash of all names, and names outside of the contract."""
    names = "list_value(" + ", ".join(f"'{f}'" for f in contract.FEATURES) + ")"
    own = f"'{contract.MAJOR}.' || left(sha1(array_to_string({names}, '|')), 8) || '.' || len({names})"
    absent = "'unknown features [' || nullif(array_to_string(list_transform(list_filter(list_value({cols}), lambda c: NOT list_contains({names}, c)), lambda c: chr(39) || c || chr(39)), ', '), '') || ']'"
    fdr, w = (", ".join(f"'{c}'" for c in cols) for cols in (("fdr_home", "fdr_away"), ("w_home", "w_draw", "w_away")))
    return f"""WITH p AS (SELECT {absent.format(cols=fdr, names=names)} AS problem UNION ALL SELECT 'version v1.00000000.3 is not ' || {own} UNION ALL SELECT {absent.format(cols=w, names=names)})
        SELECT problem, (SELECT count(*) FROM fx_match) AS n_rows FROM p WHERE problem IS NOT NULL"""


@query("q13_feature_set_compatibility", _q13_sql())
def q13(spark, sf):
    """Why models with these features may not score the table; the match table supplies the names."""
    cols = silver.match(spark, sf).columns
    problems = contract.incompatibility(contract.feature_set_version(), [c for c in cols if c.startswith("fdr_")])
    problems += contract.incompatibility("v1.00000000.3", [c for c in cols if c.startswith("w_")])
    table = spark.createDataFrame([(p,) for p in problems], "problem string")
    return table.join(silver.match(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")), how="cross")


_RULES = {"classes": "result IN ('home', 'draw', 'away')", "result_matches_goals": "(home_goals > away_goals) = (result = 'home')",
          "odds_above_one": "odds_home > 1 AND odds_draw > 1 AND odds_away > 1", "two_teams": "home <> away",
          "shots_cover_goals": "home_shots >= home_goals AND away_shots >= away_goals", "few_cards": "home_reds + away_reds = 0"}


@query("q14_table_invariants", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS violations FROM fx_match" for n, c in _RULES.items()))
def q14(spark, sf):
    return ck.rule_table(silver.match(spark, sf), {n: F.expr(c) for n, c in _RULES.items()})


# a season has 380 matches between 20 teams, and its odds and expected goals are nearly complete (fixed values)
KEYS = {"match": ("season", "fixture_id"), "player": ("season", "fixture_id", "line_no"), "cut": ("season", "gameweek"), "team": ("n_name",)}
CONSTRAINTS = [
    Rule("match", "keys_present", "season IS NOT NULL AND match_date IS NOT NULL AND home IS NOT NULL AND away IS NOT NULL"),
    Rule("match", "result_known", "result IS NULL OR result IN ('home', 'draw', 'away')"),
    Rule("match", "result_is_that_of_the_goals", "result = CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals < away_goals THEN 'away' ELSE 'draw' END"),
    Rule("match", "two_teams", "home <> away"),
    *[Rule("match", f"{c}_above_one", f"{c} IS NULL OR {c} > 1") for c in ("odds_home", "odds_draw", "odds_away")],
    *[Rule("match", f"{c}_from_1_to_5", f"{c} IS NULL OR {c} BETWEEN 1 AND 5") for c in ("fdr_home", "fdr_away")],
    Rule("match", "gameweek_in_range", "gameweek IS NULL OR gameweek BETWEEN 1 AND 38"),
    Rule("match", "weights_positive", "w_home > 0 AND w_draw > 0 AND w_away > 0"),
    Rule("match", "fixture_once", "count(*) = 1", ("season", "fixture_id")),
    Rule("match", "pair_once", "count(*) = 1", ("season", "home", "away")),
    Rule("match", "matches_of_a_season", "count(*) = 380", ("season",)),
    Rule("match", "odds_nearly_complete", "100 * count(odds_home) > 95 * count(*)", ("season",)),
    Rule("match", "gameweeks_present", "count(DISTINCT gameweek) >= 38", ("season",)),
    Rule("cut", "cutoff_present", "cutoff IS NOT NULL"),
    Rule("cut", "one_cutoff", "count(DISTINCT cutoff) = 1", ("season", "gameweek")),
    Rule("player", "keys_present", "season IS NOT NULL AND gameweek IS NOT NULL AND team IS NOT NULL"),
    Rule("player", "position_known", "position IS NULL OR position IN ('GK', 'DEF', 'MID', 'FWD')"),
    Rule("player", "minutes_from_0_to_120", "minutes IS NULL OR minutes BETWEEN 0 AND 120"),
    Rule("player", "xg_nearly_complete", "100 * count(xg) >= 99 * count(*)", ("season",)),
    Rule("player", "player_once_in_a_match", "count(*) = 1", ("season", "fixture_id", "player")),
    Reference("match", "home_is_a_team", ("home",), "team", ("n_name",)),
    Reference("match", "away_is_a_team", ("away",), "team", ("n_name",)),
    Reference("player", "team_is_a_team", ("team",), "team", ("n_name",)),
    Reference("player", "match_exists", ("season", "fixture_id"), "match", ("season", "fixture_id")),
    Reference("match", "cutoff_exists", ("season", "gameweek"), "cut", ("season", "gameweek")),
]


def _constraint_sql(r: Rule | Reference) -> str:
    of = {"match": "fx_match", "player": "fx_player", "cut": "fx_cut", "team": "nation"}
    head = f"SELECT '{r.table}' AS table_name, '{r.name}' AS rule"
    if isinstance(r, Reference):
        same = " AND ".join(f"t.{b} = s.{a}" for a, b in zip(r.columns, r.target_columns, strict=True))
        return f"{head}, count(*) AS violations, min(concat_ws('|', {', '.join('s.' + c for c in r.columns)})) AS sample FROM {of[r.table]} s WHERE NOT EXISTS (SELECT 1 FROM {of[r.target]} t WHERE {same})"
    by = r.by or KEYS[r.table]
    rows = f"SELECT concat_ws('|', {', '.join(by)}) AS k, {r.ok} AS ok FROM {of[r.table]}" + (f" GROUP BY {', '.join(by)}" if r.by else "")
    return f"{head}, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS violations, min(k) FILTER (WHERE NOT coalesce(ok, false)) AS sample FROM ({rows})"


@query("q14_constraint_suite", " UNION ALL ".join(map(_constraint_sql, CONSTRAINTS)))
def q14_suite(spark, sf):
    tables = {"match": silver.match(spark, sf), "player": silver.player(spark, sf), "cut": silver.cutoffs(spark, sf), "team": silver.table(spark, sf, "nation")}
    return violations(tables, KEYS, CONSTRAINTS)


@query("q15_freshness_diagnosis", f"""WITH g AS (SELECT season, max(kick) FILTER (WHERE kick < {NOW}) AS played, min(cutoff) FILTER (WHERE kick >= {NOW}) AS nxt, max(kick) AS built FROM fx_match JOIN fx_cut USING (season, gameweek) GROUP BY season)
    SELECT season, CASE WHEN nxt IS NULL THEN 'nothing_to_predict' WHEN played >= nxt THEN 'played_past_cutoff' WHEN nxt <= {NOW} AND {NOW} - built < 10800000000 THEN 'waiting_for_source' WHEN nxt <= {NOW} THEN 'cutoff_passed' ELSE 'fresh' END AS diagnosis FROM g""")
def q15(spark, sf):
    now = played_until()
    m = silver.match(spark, sf).join(sized_broadcast(silver.cutoffs(spark, sf)), ["season", "gameweek"])
    played = F.col("kick") < now
    g = m.groupBy("season").agg(F.max(F.when(played, F.col("kick"))).alias("played"), F.min(F.when(~played, F.col("cutoff"))).alias("nxt"), F.max("kick").alias("built"))
    return g.select("season", ck.freshness(F.col("built"), F.col("played"), F.col("nxt"), now).alias("diagnosis"))


@query("q16_teams_without_history", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT home_id FROM fx_match)")
def q16(spark, sf):
    have = silver.match(spark, sf).select(F.col("home_id").alias("id")).distinct()
    return silver.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(have, "id", "left_anti")


# -- registry and versions -------------------------------------------------------------------------

GW = ["season", "gameweek"]


@query("v01_archive_before_overwrite", "SELECT * FROM (VALUES (1, 1), (2, 2), (3, 1)) v(write_no, version_live)")
def v01(spark, sf):
    """Three writes; the third repeats the first, so version 1 is live again and nothing is stored twice."""
    t = VersionedTable(spark, "archive", unique=True)
    m = silver.match(spark, sf).select("season", "fixture_id", "result")
    later = m.filter(F.col("season") > 1995)
    live = [t.write(m, "first"), t.write(later, "second"), t.write(m.repartition(3), "third")]
    out = spark.createDataFrame(list(enumerate(live, 1)), "write_no int, version_live int")
    return out


@query("v02_version_inventory", "SELECT 1 AS version, count(*) AS n_rows, 3 AS n_columns, 'all' AS label, false AS live FROM fx_match UNION ALL SELECT 2, count(*) FILTER (WHERE season > 1995), 2, 'recent', true FROM fx_match")
def v02(spark, sf):
    t = VersionedTable(spark, "inventory", unique=True)
    m = silver.match(spark, sf)
    t.write(m.select("season", "fixture_id", "result"), "all")
    t.write(m.filter(F.col("season") > 1995).select("season", "fixture_id"), "recent")
    return t.inventory().select("version", "n_rows", "n_columns", "label", "live")


@query("v03_labelled_snapshot", "SELECT 'release' AS label, 'match' AS name, count(*) AS n_rows FROM fx_match UNION ALL SELECT 'release', 'player', count(*) FROM fx_player")
def v03(spark, sf):
    out = None
    for name, df in (("match", silver.match(spark, sf).select("season", "fixture_id")), ("player", silver.player(spark, sf).select("season", "fixture_id", "player"))):
        t = VersionedTable(spark, f"snap-{name}", unique=True)
        t.write(df, "built")
        t.snapshot("release")
        one = t.manifest().filter(F.col("event") == "snapshot").select("label", F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("v04_restore_version", "SELECT season, count(*) AS n FROM fx_match GROUP BY season")
def v04(spark, sf):
    t = VersionedTable(spark, "restore", unique=True)
    m = silver.match(spark, sf).select("season", "fixture_id")
    first = t.write(m, "all")
    t.write(m.filter(F.col("season") > 1995), "recent")
    t.restore(first)
    return t.read().groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("v05_version_history", "SELECT 1 AS version, NULL::BIGINT AS d_rows, NULL::INT AS d_columns UNION ALL SELECT 2, -count(*) FILTER (WHERE season <= 1995), -1 FROM fx_match")
def v05(spark, sf):
    t = VersionedTable(spark, "history", unique=True)
    m = silver.match(spark, sf)
    t.write(m.select("season", "fixture_id", "result"), "all")
    t.write(m.filter(F.col("season") > 1995).select("season", "fixture_id"), "recent")
    return t.history().select("version", "d_rows", "d_columns")


@query("v06_list_registry", "SELECT season, gameweek, predicted_at, count(*) AS n_rows FROM fx_emitted GROUP BY ALL")
def v06(spark, sf):
    return reg.emission_list(silver.emissions(spark, sf), GW).drop("_start")


_GOV = """e AS (SELECT season, gameweek, predicted_at, min(kick) AS start FROM fx_emitted GROUP BY ALL),
    g AS (SELECT season, gameweek, coalesce(max(predicted_at) FILTER (WHERE predicted_at < start), min(predicted_at)) AS predicted_at, count(*) FILTER (WHERE predicted_at < start) > 0 AS pre_deadline, count(*) AS n_emissions FROM e GROUP BY ALL)"""


@query("v07_governing_prediction", f"WITH {_GOV} SELECT * FROM g")
def v07(spark, sf):
    return reg.governing(silver.emissions(spark, sf), GW)


@query("v08_append_only_if_different", """WITH h AS (SELECT season, gameweek, model, predicted_at, count(*) AS n FROM fx_emitted GROUP BY ALL), c AS (SELECT *, lag(predicted_at) OVER w AS prev, lag(model) OVER w AS prev_model, lag(n) OVER w AS prev_n FROM h WINDOW w AS (PARTITION BY season, gameweek ORDER BY predicted_at, model)),
    s AS (SELECT c.season, c.gameweek, c.model, c.predicted_at, c.n, count(p.fixture_id) FILTER (WHERE c.model = c.prev_model AND abs(a.p_home - p.p_home) <= 1e-12 AND abs(a.p_draw - p.p_draw) <= 1e-12 AND abs(a.p_away - p.p_away) <= 1e-12) AS same
      FROM c JOIN fx_emitted a ON a.season = c.season AND a.gameweek = c.gameweek AND a.predicted_at = c.predicted_at AND a.model = c.model
      LEFT JOIN fx_emitted p ON p.season = c.season AND p.gameweek = c.gameweek AND p.predicted_at = c.prev AND p.model = c.prev_model AND p.fixture_id = a.fixture_id GROUP BY ALL)
    SELECT season, gameweek, model, predicted_at, n AS n_rows, same = n AS repeated FROM s""")
def v08(spark, sf):
    return reg.repeats(silver.emissions(spark, sf), GW, ["fixture_id"], ["model"])


@query("v09_registry_cleanup_plan", """WITH e AS (SELECT season, gameweek, model, predicted_at, count(*) AS n_rows, min(kick) AS start FROM fx_emitted GROUP BY ALL),
    g AS (SELECT season, gameweek, coalesce(max(predicted_at) FILTER (WHERE predicted_at < start), min(predicted_at)) AS gov, count(*) FILTER (WHERE predicted_at < start) > 0 AS pre FROM e WHERE model = 'm2' GROUP BY ALL)
    SELECT e.season, e.gameweek, e.model, e.predicted_at, e.n_rows, CASE WHEN g.gov IS NULL THEN 'warn' WHEN NOT (e.model = 'm2' AND e.predicted_at = g.gov) THEN 'drop' WHEN g.pre THEN 'keep' ELSE 'keep_late' END AS action FROM e LEFT JOIN g USING (season, gameweek)""")
def v09(spark, sf):
    return reg.cleanup_plan(silver.emissions(spark, sf), GW, "m2")


# -- logs ------------------------------------------------------------------------------------------

@query("g01_requests_by_status", """SELECT kind, status, CASE WHEN kind = 'app' THEN event_type END AS model, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS n_errors FROM fx_log GROUP BY ALL""")
def g01(spark, sf):
    log = silver.request_log(spark, sf).withColumn("model", F.when(F.col("kind") == "app", F.col("event_type")))
    return logs.request_counts(log, ["kind", "status", "model"])


@query("g02_latency_percentiles", """WITH l AS (SELECT kind, event_type, TRY_CAST(replace(latency, 's', '') AS DOUBLE) * 1000 AS ms FROM fx_log WHERE regexp_full_match(latency, '[0-9.]+s'))
    SELECT kind, event_type, count(*) AS n, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(max(ms), 4) AS "max" FROM l GROUP BY ALL""")
def g02(spark, sf):
    return rounded(logs.latency_summary(silver.request_log(spark, sf), ["kind", "event_type"]), "p50", "p95", "max", digits=4)


@query("g03_last_trigger_and_end", """WITH t AS (SELECT user_id, max("at") AS triggered_at, arg_max(event_id, row("at", event_id)) AS trigger_id, arg_max(task_id, row("at", event_id)) AS task_id FROM fx_log WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT t.user_id, triggered_at, trigger_id, t.task_id, min(l."at") AS ended_at, arg_min(l.status, row(l."at", l.status)) AS end_status FROM t LEFT JOIN fx_log l ON l.user_id = t.user_id AND l.task_id = t.task_id AND l.event_type = 'click' AND l."at" >= t.triggered_at GROUP BY t.user_id, triggered_at, trigger_id, t.task_id""")
def g03(spark, sf):
    return logs.last_trigger_with_end(silver.request_log(spark, sf), F.col("event_type") == "purchase", F.col("event_type") == "click", ["user_id"])


@query("g04_run_journal_steps", """SELECT run, step, round(sum(seconds), 4) AS seconds, count(*) FILTER (WHERE NOT ok) AS n_failed, count(*) AS n_steps, CAST(CASE WHEN grouping(run) = 1 THEN 3 WHEN grouping(step) = 1 THEN 1 ELSE 0 END AS INT) AS level
    FROM (SELECT o_custkey AS run, o_orderpriority AS step, o_totalprice AS seconds, o_orderstatus <> 'F' AS ok FROM orders) GROUP BY ROLLUP (run, step)""")
def g04(spark, sf):
    o = silver.table(spark, sf, "orders")
    step = F.struct(F.col("o_orderpriority").alias("step"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderstatus") != "F").alias("ok"))
    # a journal row per order with its one-step list; rows of a run need not sit together
    journal = o.select(F.col("o_custkey").alias("run"), F.array(step).alias("steps"))
    return logs.journal_steps(journal, ["run"]).withColumn("seconds", F.round("seconds", 4))


@query("g05_announcement_summary", f"SELECT season, gameweek, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {P} = '{c}') AS n_{c}" for c in CLASSES) + ", round(avg(greatest(p_away, p_draw, p_home)), 6) AS mean_confidence FROM fx_pred GROUP BY ALL")
def g05(spark, sf):
    return rounded(logs.announcement_summary(labelled(spark, sf), ["season", "gameweek"], "said", ["p_away", "p_draw", "p_home"]), "mean_confidence")


_VERSIONS = """SELECT model, CAST(season AS VARCHAR) AS version, CAST(count(DISTINCT gameweek) AS INT) AS n_features,
    CASE WHEN season % 2 = 0 THEN 'even' ELSE 'odd' END AS feature_set_version, max(predicted_at) AS built_at, count(*) AS n FROM fx_emitted GROUP BY model, season"""


def _model_versions(spark, sf):
    """Every season of a model's emissions stands for one trained version."""
    return (silver.emissions(spark, sf).groupBy("model", "season")
            .agg(F.countDistinct("gameweek").cast("int").alias("n_features"), F.max("predicted_at").alias("built_at"), F.count(F.lit(1)).alias("n"))
            .select("model", F.col("season").cast("string").alias("version"), "n_features",
                    F.when(F.col("season") % 2 == 0, "even").otherwise("odd").alias("feature_set_version"), "built_at", "n"))


@query("v10_model_inventory", f"""WITH v AS ({_VERSIONS}), p AS (SELECT model, max(version) AS version FROM v WHERE CAST(version AS INT) % 3 <> 0 GROUP BY model)
    SELECT v.model, v.version, n_features, feature_set_version, built_at, p.version IS NOT NULL AS production,
    CAST(v.version AS BIGINT) % 4 AS n_files, CAST(v.version AS BIGINT) % 4 > 0 AS servable FROM v LEFT JOIN p ON v.model = p.model AND v.version = p.version""")
def v10(spark, sf):
    """Metadata as JSON lines, a pointer per model to its latest promoted version, and a listing of model files."""
    at = scratch_path(spark, "v10")
    own = _model_versions(spark, sf)
    own.drop("n").write.json(f"{at}/metadata")
    meta = spark.read.schema(reg.MODEL_META).json(f"{at}/metadata")
    year = F.col("version").cast("int")
    pointers = meta.filter(year % 3 != 0).groupBy("model").agg(F.max("version").alias("version"))
    files = meta.filter(year % 4 > 0).select("model", "version", F.explode(F.sequence(F.lit(1), year % 4)).alias("file_no"))
    return reg.model_inventory(meta, pointers, files)


@query("v11_rejected_attempts", f"""WITH v AS ({_VERSIONS}), m AS (SELECT model, avg(n) AS mean_n FROM v GROUP BY model)
    SELECT model, version, 'rejected' AS outcome, 'fewer forecasts than usual' AS reason, built_at AS "at" FROM v JOIN m USING (model) WHERE n < mean_n""")
def v11(spark, sf):
    """Two appends, one per half of the seasons; both are read back."""
    path = scratch_path(spark, "v11")
    own = _model_versions(spark, sf)
    usual = own.groupBy("model").agg(F.avg("n").alias("mean_n"))
    failed = (own.join(usual, "model").filter("n < mean_n")
              .select("model", "version", F.lit("fewer forecasts than usual").alias("reason"), F.col("built_at").alias("at")))
    for half in (0, 1):
        reg.log_rejections(failed.filter(F.col("version").cast("int") % 2 == half), path)
    return reg.rejections(spark, path)
