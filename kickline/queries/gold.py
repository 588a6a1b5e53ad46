"""The assembled table."""

import datetime as dt

from pyspark.sql import functions as F

from kickline.plans import contract as ct
from kickline.plans import form, gold
from kickline.queries.base import DAY, query
from kickline.queries.columns import SPLIT_SQL
from kickline.queries.aggregates import STATUS_SQL
from kickline.queries.joins import played_until
from kickline.queries.windows import rounded
from kickline.sources import silver

TRAIN = [1995, 1996, 1997, 1998, 1999]
HOLDOUT, CURRENT = 2000, 2001
_built: dict[tuple[str, str], object] = {}


def built_gold(spark, sf):
    """The validated table. Its matches and views are written once per application; a reader joins the columns it asks for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        g = gold.build(gold.from_silver(spark, sf), played_until(), CURRENT, HOLDOUT, TRAIN, {1996: 16})
        _built[key] = gold.validate(g, CURRENT)
    return _built[key]


_NOW = "epoch_us(TIMESTAMP '2001-07-01')"
_CORE = f"""fx AS (SELECT m.*, c.cutoff, m.kick < {_NOW} AS played, m.kick >= {_NOW} AND c.cutoff < {_NOW} - {7 * DAY} AS postponed FROM fx_match m JOIN fx_cut c USING (season, gameweek)),
    nxt AS (SELECT min(gameweek) AS gw FROM (SELECT f.gameweek, f.cutoff, count(*) FILTER (WHERE NOT played AND NOT postponed) AS pend FROM fx f WHERE season = 2001 GROUP BY ALL) g
      WHERE pend > 0 AND NOT EXISTS (SELECT 1 FROM fx p WHERE p.season = 2001 AND p.kick < g.cutoff AND NOT p.played AND NOT p.postponed)),
    tg AS (SELECT fx.* FROM fx LEFT JOIN nxt ON true WHERE played OR (season = 2001 AND gameweek = nxt.gw)),
    lg AS (SELECT * FROM fx_long WHERE kick < {_NOW}),
    h AS (SELECT team, season, kick, avg(pts) OVER w5 AS pts_u5, avg(shots) OVER w3 AS shots_u3, avg(gf) OVER s5 AS gf_s, sum(pts) OVER s AS camp, count(*) OVER s AS played, count(*) OVER (PARTITION BY team ORDER BY kick RANGE BETWEEN {14 * DAY - 1} PRECEDING AND CURRENT ROW) AS d14,
      least(38, count(*) OVER (PARTITION BY team ORDER BY kick, fixture_id)) AS n_hist FROM lg
      WINDOW w3 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 2 PRECEDING), w5 AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING), s5 AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS 4 PRECEDING), s AS (PARTITION BY season, team ORDER BY kick, fixture_id ROWS UNBOUNDED PRECEDING)),
    hc AS (SELECT team, is_home, kick, avg(gd) OVER (PARTITION BY team, is_home ORDER BY kick, fixture_id ROWS 4 PRECEDING) AS gd_cond FROM lg),
    sd AS (SELECT season, fixture_id, kick, cutoff, home AS team, true AS is_home FROM tg UNION ALL SELECT season, fixture_id, kick, cutoff, away, false FROM tg),
    a AS (SELECT sd.*, h.* EXCLUDE (team, season, kick), h.season AS hs, h.kick AS hk, hc.gd_cond FROM sd ASOF LEFT JOIN h ON h.team = sd.team AND sd.cutoff > h.kick ASOF LEFT JOIN hc ON hc.team = sd.team AND hc.is_home = sd.is_home AND sd.cutoff > hc.kick)"""


def _pick(e, side):
    return f"max({e}) FILTER (WHERE {'' if side == 'home' else 'NOT '}is_home)"


@query("gold_match_core", f"""WITH {_CORE} SELECT a.season, a.fixture_id, """ + ", ".join(
    f"round({_pick('pts_u5', s)}, 6) AS {s}_pts_u5, round({_pick('shots_u3', s)}, 6) AS {s}_shots_u3, round({_pick('CASE WHEN hs = a.season THEN gf_s END', s)}, 6) AS {s}_gf_u5_season, round({_pick('gd_cond', s)}, 6) AS {s}_gd_cond_u5, "
    f"CAST(coalesce({_pick('CASE WHEN hs = a.season THEN camp END', s)}, 0) AS BIGINT) AS {s}_pts_camp, {_pick('d14', s)} AS {s}_games_14d, coalesce({_pick('n_hist', s)}, 0) AS {s}_n_hist, round({_pick(f'(a.kick - hk) / {DAY}', s)}, 6) AS {s}_rest_days"
    for s in ("home", "away")) + f""", round({_pick('pts_u5', 'home')} - {_pick('pts_u5', 'away')}, 6) AS dif_pts_u5, any_value(t.fdr_home - t.fdr_away) AS fdr_dif, any_value(CASE WHEN t.kick < {_NOW} THEN t.result END) AS target,
    any_value(CASE WHEN t.kick >= {_NOW} THEN 'inference' WHEN t.season = 2000 THEN 'holdout' WHEN t.season < 2000 THEN 'train' ELSE 'current' END) AS split
    FROM a JOIN tg t ON t.season = a.season AND t.fixture_id = a.fixture_id GROUP BY a.season, a.fixture_id""")
def gold_core(spark, sf):
    """A slice of the assembled table over all its rows."""
    means = ["pts_u5", "shots_u3", "gf_u5_season", "gd_cond_u5", "rest_days"]
    cols = [f"{s}_{c}" for s in ("home", "away") for c in (*means, "pts_camp", "games_14d", "n_hist")]
    g = built_gold(spark, sf).select("season", "fixture_id", *cols, "dif_pts_u5", "fdr_dif", "target", "split")
    return rounded(g, *[f"{s}_{c}" for s in ("home", "away") for c in means], "dif_pts_u5")


@query("gold_match_full")
def gold_full(spark, sf):
    return built_gold(spark, sf)


_FLAG = "pts shots sot cards"


@query("flagship_recent_form", """WITH h AS (SELECT team, kick, """ + ", ".join(f"avg({s}) OVER w AS {s}" for s in _FLAG.split()) + """ FROM fx_long WINDOW w AS (PARTITION BY team ORDER BY kick, fixture_id ROWS 4 PRECEDING)),
    a AS (SELECT o.*, h.kick AS hk, """ + ", ".join(f"h.{s}" for s in _FLAG.split()) + """ FROM fx_obj o ASOF LEFT JOIN h ON h.team = o.team AND o.cutoff > h.kick)
    SELECT season, gameweek, fixture_id, cutoff, """ + ", ".join(f"max(hk) FILTER (WHERE {n}is_home) AS {p}_hist_kick, " + ", ".join(f"round(max({s}) FILTER (WHERE {n}is_home), 6) AS {p}_{s}_u5" for s in _FLAG.split()) for p, n in (("home", ""), ("away", "NOT ")))
    + ", " + ", ".join(f"round(max({s}) FILTER (WHERE is_home) - max({s}) FILTER (WHERE NOT is_home), 6) AS dif_{s}_u5" for s in _FLAG.split()) + " FROM a GROUP BY ALL")
def flagship(spark, sf):
    df = form.recent_form(silver.team_match(spark, sf), _FLAG.split())
    return rounded(df, *[c for c in df.columns if c.endswith("_u5")])
