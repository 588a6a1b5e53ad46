"""Registry of queries with their DuckDB twins, and the shared table definitions in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY = 86_400_000_000

CTE: dict[str, str] = {
    "fx_first": """SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
        FROM lineitem) WHERE rn = 1""",
    "fx_match": """SELECT *, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS result FROM (
        SELECT CAST(year(o_orderdate) AS INT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INT) AS gameweek,
        o_orderkey AS fixture_id, epoch_us(o_orderdate) + o_orderkey AS kick, CAST(o_orderdate AS DATE) AS match_date,
        hn.n_name AS home, an.n_name AS away, r_name AS division, l_suppkey AS home_id, o_custkey AS away_id,
        CAST(l_quantity AS BIGINT) % 6 AS home_goals, CAST(floor(l_extendedprice) AS BIGINT) % 5 AS away_goals,
        CAST(l_quantity AS BIGINT) % 6 + l_partkey % 15 AS home_shots, CAST(floor(l_extendedprice) AS BIGINT) % 5 + o_custkey % 13 AS away_shots,
        CAST(l_quantity AS BIGINT) % 6 + (l_partkey % 15) // 2 AS home_sot, CAST(floor(l_extendedprice) AS BIGINT) % 5 + (o_custkey % 13) // 2 AS away_sot,
        l_partkey % 11 AS home_corners, o_custkey % 11 AS away_corners, l_suppkey % 17 AS home_fouls, o_custkey % 17 AS away_fouls,
        l_suppkey % 4 AS home_yellows, o_custkey % 4 AS away_yellows,
        CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS home_reds, CASE WHEN o_custkey % 19 = 0 THEN 1 ELSE 0 END AS away_reds,
        1 + o_orderkey % 5 AS fdr_home, 1 + o_custkey % 5 AS fdr_away,
        CASE WHEN o_orderkey % 50 <> 0 THEN (12 + l_partkey % 40) / 10.0::DOUBLE END AS odds_home,
        CASE WHEN o_orderkey % 50 <> 0 THEN (28 + o_custkey % 15) / 10.0::DOUBLE END AS odds_draw,
        CASE WHEN o_orderkey % 50 <> 0 THEN (15 + o_orderkey % 50) / 10.0::DOUBLE END AS odds_away,
        30 + l_partkey % 41 AS w_home, 15 + o_custkey % 26 AS w_draw, 20 + o_orderkey % 38 AS w_away,
        30 + l_partkey % 37 AS wb_home, 15 + o_custkey % 23 AS wb_draw, 20 + o_orderkey % 43 AS wb_away
        FROM orders JOIN fx_first ON o_orderkey = l_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation hn ON s_nationkey = hn.n_nationkey JOIN region ON hn.n_regionkey = r_regionkey
        JOIN customer ON o_custkey = c_custkey JOIN nation an ON c_nationkey = an.n_nationkey
        WHERE hn.n_name <> an.n_name)""",
    "fx_long": """SELECT *, CASE WHEN gf > gc THEN 3 WHEN gf = gc THEN 1 ELSE 0 END AS pts, gf - gc AS gd FROM (
        SELECT season, gameweek, fixture_id, kick, true AS is_home, home AS team, away AS rival, home_goals AS gf, away_goals AS gc,
        home_shots AS shots, home_sot AS sot, home_corners AS corners, home_fouls AS fouls, home_yellows + 2 * home_reds AS cards FROM fx_match
        UNION ALL
        SELECT season, gameweek, fixture_id, kick, false, away, home, away_goals, home_goals,
        away_shots, away_sot, away_corners, away_fouls, away_yellows + 2 * away_reds FROM fx_match)""",
    "fx_club": """SELECT season, gameweek, fixture_id, kick, 'C' || CAST(away_id AS VARCHAR) AS team, away_goals AS gf, home_goals AS gc, away_shots AS shots,
        CASE WHEN away_goals > home_goals THEN 3 WHEN away_goals = home_goals THEN 1 ELSE 0 END AS pts FROM fx_match""",
    "fx_cut": "SELECT season, gameweek, min(kick) AS cutoff FROM fx_match GROUP BY season, gameweek",
    "fx_obj": "SELECT l.season, l.gameweek, l.fixture_id, l.kick, l.is_home, l.team, l.rival, c.cutoff FROM fx_long l JOIN fx_cut c USING (season, gameweek)",
    "fx_player": """SELECT season, gameweek, fixture_id, kick, CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END AS team,
        'P' || CAST(l_partkey % 40 AS VARCHAR) AS player, CASE l_partkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position,
        least(90, 2 * CAST(l_quantity AS BIGINT)) AS minutes, l_discount AS xg, l_tax AS xa, CAST(l_quantity AS BIGINT) % 13 AS points,
        l_suppkey % 6 AS saves, CASE WHEN l_linenumber % 2 = 1 THEN away_goals ELSE home_goals END AS conceded,
        l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no, l_extendedprice AS price
        FROM lineitem JOIN fx_match ON l_orderkey = fixture_id""",
    "fx_comp": """SELECT CAST(year(ts) AS INT) AS season, event_id, epoch_us(ts) AS kick, 'U' || CAST(user_id AS VARCHAR) AS team,
        CASE event_type WHEN 'view' THEN 'premier' WHEN 'click' THEN 'facup' WHEN 'signup' THEN 'eflcup' WHEN 'purchase' THEN 'champions' WHEN 'error' THEN 'europa' END AS competition,
        CAST(floor(value) AS BIGINT) % 5 AS gf, event_id % 4 AS gc,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 END AS round_weight,
        event_id % 50 <> 0 AS finished FROM events""",
    "fx_compobj": """SELECT DISTINCT team, cutoff, CAST(year(make_timestamp(cutoff)) AS INT) AS season FROM
        (SELECT team, epoch_us(CAST(date_trunc('week', make_timestamp(kick)) AS TIMESTAMP)) AS cutoff FROM fx_comp)""",
    "fx_valuation": """SELECT o_custkey AS player_id, o_orderkey AS valuation_id, epoch_us(o_orderdate) AS day, 'N' || CAST(o_orderkey % 25 AS VARCHAR) AS club,
        CASE o_custkey % 4 WHEN 0 THEN 'gk' WHEN 1 THEN 'def' WHEN 2 THEN 'mid' ELSE 'fwd' END AS line,
        CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders""",
    "fx_pred": """SELECT season, gameweek, fixture_id, kick, home, away, result,
        w_away / (w_home + w_draw + w_away) AS p_away, w_draw / (w_home + w_draw + w_away) AS p_draw, w_home / (w_home + w_draw + w_away) AS p_home,
        wb_away / (wb_home + wb_draw + wb_away) AS q_away, wb_draw / (wb_home + wb_draw + wb_away) AS q_draw, wb_home / (wb_home + wb_draw + wb_away) AS q_home,
        odds_away, odds_draw, odds_home FROM fx_match""",
    "fx_emitted": f"""SELECT f.season, f.gameweek, f.fixture_id, f.kick, e.cutoff, e.model, e.predicted_at,
        CASE WHEN model = 'm2' THEN q_away ELSE p_away END AS p_away, CASE WHEN model = 'm2' THEN q_draw ELSE p_draw END AS p_draw,
        CASE WHEN model = 'm2' THEN q_home ELSE p_home END AS p_home
        FROM fx_pred f JOIN (
          SELECT season, gameweek, cutoff, 'm1' AS model, cutoff - {2 * DAY} AS predicted_at FROM fx_cut WHERE gameweek % 5 <> 0
          UNION ALL SELECT season, gameweek, cutoff, 'm2', cutoff - 3600000000 FROM fx_cut WHERE gameweek % 3 <> 0
          UNION ALL SELECT season, gameweek, cutoff, 'm1', cutoff + {DAY} FROM fx_cut) e USING (season, gameweek)""",
    "fx_manifest": """SELECT event_type AS source, CAST(year(ts) AS INT) AS season, 'd' || CAST(user_id % 7 AS VARCHAR) AS dataset, epoch_us(ts) AS stamp,
        event_id, event_id % 11 = 0 AS no_manifest, event_id % 11 <> 0 AND event_id % 13 = 0 AS no_entries,
        event_id % 3 = 0 AND event_id % 5 <> 0 AS all_rejected FROM events""",
    "fx_names": """SELECT s_suppkey AS raw_id, CASE s_suppkey % 6 WHEN 0 THEN upper(replace(n_name, '_', ' ')) WHEN 1 THEN ' ' || replace(n_name, '_', ' ') || ' Utd.'
        WHEN 2 THEN replace(n_name, '_', ' ') || ' Town FC' WHEN 3 THEN replace(replace(n_name, '_', ' '), ' ', '-')
        WHEN 4 THEN 'The ' || replace(n_name, '_', ' ') ELSE 'N''' || CAST(s_nationkey AS VARCHAR) END AS raw_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "fx_clubs": """SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS short_name,
        replace(n_name, '_', ' ') || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' City' END AS team_name FROM nation""",
    "fx_log": """SELECT event_id, epoch_us(ts) AS at, CASE WHEN event_id % 2 = 0 THEN 'edge' ELSE 'app' END AS kind,
        CASE WHEN event_id % 20 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 409 ELSE 200 END AS status,
        CASE WHEN event_id % 31 = 0 THEN 'x' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) || 's' END AS latency,
        event_type, props, 'task-' || json_extract_string(props, '$.k') AS task_id, user_id, value FROM events""",
    "fx_stats": "SELECT season, gameweek, fixture_id, kick, team, is_home, " + ", ".join(
        f"CASE WHEN (fixture_id + {i}) % 29 <> 0 THEN (fixture_id * {i + 3} + shots * 7 + {i}) % 23 END AS s{i:02d}"
        for i in range(23)) + " FROM fx_long",
}


def oracle(body: str) -> str:
    """Prefixes the shared definitions that `body` mentions, in dependency order."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTE and name not in wanted:
                need(CTE[name])
                if name not in wanted:
                    wanted.append(name)

    need(body)
    if not wanted:
        return body
    shared = ", ".join(f"{n} AS ({CTE[n]})" for n in wanted)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{shared}, {body[head.end():]}"
    return f"WITH {shared} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return fn
    return register
