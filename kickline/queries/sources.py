"""Scans and sinks (S-*). Raw files are landed from the tables and read back through the library."""

from pyspark.sql import functions as F

from kickline.operators.scoring import CLASSES
from kickline.queries.base import DAY, query
from kickline.queries.joins import played_until
from kickline.queries.windows import rounded
from kickline.session import scratch_path
from kickline.sources import detailed, landing, silver
from kickline.sources.rename import MATCH_COLUMNS, RESULT_CODES, present_only, recode
from kickline.sources.versions import VersionedTable

PAGE = 1000   # fixtures per landed page
PAGES_PER_FILE = 64   # about a third of a megabyte each


def _match_csv(spark, sf):
    m = silver.match(spark, sf)
    return m.select(F.lit("E0").alias(landing.BOM + "Div"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
                    F.col("home").alias("HomeTeam"), F.col("away").alias("AwayTeam"), F.col("home_goals").alias("FTHG"),
                    F.col("away_goals").alias("FTAG"), F.upper(F.substring("result", 1, 1)).alias("FTR"),
                    F.col("odds_home").alias("AvgCH"), F.col("fixture_id").alias("Id"), "season")


@query("s01_csv_with_bom", "SELECT fixture_id, home AS fd_home, away AS fd_away, CAST(home_goals AS BIGINT) AS home_goals, result FROM fx_match")
def s01(spark, sf):
    path = landing.write_raw(_match_csv(spark, sf), scratch_path(spark, "s01"), "20240101T000000Z", header="true")
    raw = landing.read_csv(spark, path, required=["Div", "Date", "HomeTeam"])
    cols = present_only(raw, {"Id": "fixture_id", **MATCH_COLUMNS})
    return cols.select(F.col("fixture_id").cast("long"), "fd_home", "fd_away", F.col("home_goals").cast("long"),
                       recode(F.col("result"), RESULT_CODES).alias("result"))


@query("s02_csv_malformed_rows", "SELECT fixture_id, home, away, CAST(home_goals AS BIGINT) AS home_goals FROM fx_match WHERE fixture_id % 10 <> 3 AND fixture_id % 10 <> 4")
def s02(spark, sf):
    """Every tenth line has too many fields and another tenth lacks the score."""
    m = silver.match(spark, sf)
    k = F.col("fixture_id") % 10
    line = (F.when(k == 3, F.concat_ws(",", "fixture_id", "home", "away", "home_goals", "away_goals", F.lit("9")))
            .when(k == 4, F.concat_ws(",", "fixture_id", "home", "away")).otherwise(F.concat_ws(",", "fixture_id", "home", "away", "home_goals", "away_goals")))
    path = scratch_path(spark, "s02")
    m.select(line.alias("value")).write.text(path)
    cols = ["fixture_id", "home", "away", "home_goals", "away_goals"]
    good = landing.usable(landing.read_csv_skipping_bad_lines(spark, path, cols), ["home", "away", "home_goals", "away_goals"])
    return good.select(F.col("fixture_id").cast("long"), "home", "away", F.col("home_goals").cast("long"))


def _side(team, goals):
    return F.struct(F.struct(F.lit(1.0).alias("id"), F.col(team).alias("name"), F.struct(F.lower(team).alias("abbr")).alias("club")).alias("team"),
                    F.col(goals).cast("double").alias("score"))


@query("s03_nested_fixture_pages", "SELECT season, fixture_id, is_home, upper(team) AS team, rival AS rival_name, CAST(gf AS DOUBLE) AS gf, CAST(gc AS DOUBLE) AS gc, kick // 1000 * 1000 AS kick, fixture_id % 50 <> 0 AS finished FROM fx_long")
def s03(spark, sf):
    m = silver.match(spark, sf)
    x = F.struct(F.col("fixture_id").alias("id"), F.struct(F.floor(F.col("kick") / 1000).alias("millis")).alias("kickoff"),
                 F.when(F.col("fixture_id") % 50 != 0, "C").otherwise("U").alias("status"),
                 F.array(_side("home", "home_goals"), _side("away", "away_goals")).alias("teams"),
                 F.struct(F.col("gameweek").alias("gameweek"), F.struct(F.lit("Final").alias("label")).alias("competitionPhase")).alias("gameweek"))
    pages = (m.groupBy("season", F.floor(F.col("fixture_id") / PAGE).alias("_page"))   # at most PAGE fixtures
             .agg(F.collect_list(x).alias("content")).withColumn("competition", F.lit("premier")).drop("_page"))
    path = scratch_path(spark, "s03")
    pages.write.json(path)
    return landing.read_fixture_pages(spark, path).drop("competition", "round")


_KEPT = list(detailed.STATS)


@query("s04_detailed_stats_map", "SELECT season, fixture_id, CASE WHEN is_home THEN 1 ELSE 2 END::BIGINT AS team_id, " + ", ".join(
    f"CAST(s{i:02d} AS DOUBLE) AS {c}" for i, c in enumerate(_KEPT)) + """, round(s00 / nullif(coalesce(s00, 0) + coalesce(s01, 0), 0), 6) AS box_share, round(s15 / nullif(s14, 0), 6) AS pass_accuracy FROM fx_stats""")
def s04(spark, sf):
    t = silver.team_stats(spark, sf)
    # numbers only go through the exchange; the names are added to a whole page
    names = list(detailed.STATS.values())
    per_side = t.select("season", "fixture_id", F.when(F.col("is_home"), "1.0").otherwise("2.0").alias("tid"),
                        F.array(*[F.col(f"s{i:02d}").cast("double") for i in range(len(names))]).alias("values"))
    page = F.floor(F.col("fixture_id") / PAGE).alias("_page")
    paged = per_side.select("season", page, "fixture_id", F.struct("tid", "values").alias("s")).repartition("season", "_page")
    pages = (paged.groupBy("season", "_page", "fixture_id").agg(F.collect_list("s").alias("sides"))   # two sides
             .groupBy("season", "_page").agg(F.collect_list(F.struct("fixture_id", "sides")).alias("_all")))   # at most PAGE fixtures

    def block(side):
        named = F.transform(side["values"], lambda v, i: F.struct(F.get(F.lit(names), i).alias("name"), v.alias("value")))
        return F.struct(side["tid"], F.struct(F.filter(named, lambda s: s["value"].isNotNull()).alias("M")).alias("blk"))

    def fixture(x):
        return F.struct(x["fixture_id"].cast("string").alias("fixture"), F.struct(F.map_from_entries(F.transform(x["sides"], block)).alias("data")).alias("p"))

    docs = pages.select("season", F.map_from_entries(F.transform("_all", fixture)).alias("doc"))
    path = scratch_path(spark, "s04")
    # a reader decodes up to 4,096 rows of a file at once, which would be gigabytes of pages
    docs.select("season", F.to_json("doc").alias("json")).write.option("maxRecordsPerFile", PAGES_PER_FILE).parquet(path)
    wide = detailed.derive(detailed.parse(spark.read.parquet(path), "json", ["season"]))
    return rounded(wide.select("season", "fixture_id", "team_id", *_KEPT, "box_share", "pass_accuracy"), "box_share", "pass_accuracy")


_LIVE_KEY = "season, gameweek, player || '-' || CAST(fixture_id // 50 AS VARCHAR)"


@query("s05_live_player_json", f"SELECT season, gameweek, player || '-' || CAST(fixture_id // 50 AS VARCHAR) AS player_id, min(fixture_id) AS fixture_id, CAST(sum(minutes) AS DOUBLE) AS minutes, round(max(xg), 6) AS expected_goals FROM fx_player GROUP BY {_LIVE_KEY}")
def s05(spark, sf):
    p = silver.player(spark, sf).withColumn("pid", F.concat_ws("-", "player", F.floor(F.col("fixture_id") / 50).cast("string")))
    e = p.groupBy("season", "gameweek", "pid").agg(
        F.sum("minutes").alias("m"), F.max("xg").alias("x"), F.sort_array(F.collect_set("fixture_id")).alias("fx"))   # at most 50 fixtures
    element = F.struct(F.col("pid").alias("id"), F.create_map(F.lit("minutes"), F.col("m").cast("string"), F.lit("expected_goals"), F.format_string("%.2f", "x"),
                                                              F.lit("influence"), F.lit("n/a")).alias("stats"),
                       F.transform("fx", lambda f: F.struct(f.alias("fixture"))).alias("explain"))
    path = scratch_path(spark, "s05")
    e.select("season", "gameweek", F.array(element).alias("elements")).write.json(path)
    return rounded(landing.read_live_players(spark, path, ["minutes", "expected_goals"]), "expected_goals")


@query("s06_gzip_csv", "SELECT player_id, valuation_id, value FROM fx_valuation")
def s06(spark, sf):
    v = silver.valuation(spark, sf).select("player_id", "valuation_id", "value")
    path = landing.write_raw(v, scratch_path(spark, "s06"), "20240101T000000Z", header="true", compression="gzip")
    return landing.read_csv(spark, path, pattern="*.csv.gz").select(*[F.col(c).cast("long").alias(c) for c in v.columns])


@query("s07_multi_season_scan", "SELECT season, fixture_id, home, CASE WHEN season >= 1998 THEN away END AS away FROM fx_match WHERE season <> 1997")
def s07(spark, sf):
    """Season 1997 was never landed and the early seasons lack a column."""
    root = scratch_path(spark, "s07")
    m = silver.match(spark, sf).select("season", "fixture_id", "home", "away")
    opt = {"header": "true"}
    for part, cols in ((m.filter(F.col("season") < 1997), ["fixture_id", "home"]), (m.filter(F.col("season") > 1997), ["fixture_id", "home", "away"])):
        part.select("season", *cols).write.mode("append").partitionBy("season").options(**opt).csv(root)
    return landing.read_seasons(spark, root, landing.landed_seasons(spark, root)).select("season", F.col("fixture_id").cast("long"), "home", "away")


@query("s08_append_only_raw", "SELECT '20240101T000000Z' AS stamp, count(*) AS n FROM fx_match UNION ALL SELECT '20240201T000000Z', count(*) FILTER (WHERE season > 1999) FROM fx_match")
def s08(spark, sf):
    root = scratch_path(spark, "s08")
    m = silver.match(spark, sf).select("season", "fixture_id", "home", "away")
    landing.write_raw(m, root, "20240101T000000Z", fmt="parquet")
    landing.write_raw(m.filter(F.col("season") > 1999), root, "20240201T000000Z", fmt="parquet")
    return spark.read.parquet(root).groupBy(F.col("ingested_at").alias("stamp")).agg(F.count(F.lit(1)).alias("n"))


_SNAP = "source, season, dataset"


@query("s09_latest_usable_snapshot", f"SELECT {_SNAP}, max(stamp) AS stamp FROM fx_manifest WHERE no_manifest OR no_entries OR NOT all_rejected GROUP BY ALL")
def s09(spark, sf):
    return landing.latest_usable(silver.manifest(spark, sf), ["source", "season", "dataset"])


@query("s10_snapshot_as_of", f"SELECT {_SNAP}, max(stamp) AS stamp FROM fx_manifest WHERE stamp <= epoch_us(TIMESTAMP '2024-01-15') GROUP BY ALL")
def s10(spark, sf):
    at = F.lit(1_705_276_800_000_000)
    return landing.latest_at(silver.manifest(spark, sf), ["source", "season", "dataset"], at)


@query("s11_manifest_round_trip", "SELECT source, dataset, count(*) AS n, count(*) FILTER (WHERE no_manifest) AS n_without FROM fx_manifest GROUP BY ALL")
def s11(spark, sf):
    path = scratch_path(spark, "s11")
    m = silver.manifest(spark, sf)
    m.write.mode("append").partitionBy("source").json(path)
    back = spark.read.schema(m.schema).json(path)
    return back.groupBy("source", "dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entries").isNull()).alias("n_without"))


@query("s12_table_write", "SELECT season, count(*) AS n, CAST(sum(home_goals) AS BIGINT) AS goals FROM fx_match GROUP BY season")
def s12(spark, sf):
    t = VersionedTable(spark, "fact_match", unique=True)
    t.write(silver.match(spark, sf), "silver", partition_by=["season"])
    return t.read().groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query("s13_table_read", "SELECT season, fixture_id, result FROM fx_match")
def s13(spark, sf):
    t = VersionedTable(spark, "fact_result", unique=True)
    if not t.exists():
        t.write(silver.match(spark, sf).select("season", "fixture_id", "result"), "silver")
    return t.read()


_FIN = "kick < epoch_us(TIMESTAMP '2001-07-03')"


@query("s14_gameweeks_to_fetch", f"""WITH g AS (SELECT season, gameweek, bool_and({_FIN}) AS done, bool_or({_FIN}) AS started FROM fx_match GROUP BY ALL)
    SELECT season, gameweek FROM g WHERE (done AND NOT EXISTS (SELECT 1 FROM fx_match l WHERE l.season = g.season AND l.gameweek = g.gameweek AND l.fixture_id % 45 = 0)) OR (started AND NOT done)""")
def s14(spark, sf):
    fx = silver.match(spark, sf).select("season", "gameweek", "kick", "fixture_id")
    landed = fx.filter(F.col("fixture_id") % 45 == 0)
    return landing.gameweeks_to_fetch(fx, F.col("kick") < played_until() + 2 * DAY, landed)


@query("s15_match_ids_to_fetch", "SELECT o_orderkey AS fixture_id FROM orders WHERE o_orderkey NOT IN (SELECT fixture_id FROM fx_match)")
def s15(spark, sf):
    ids = silver.table(spark, sf, "orders").select(F.col("o_orderkey").alias("fixture_id"))
    return landing.ids_to_fetch(ids, silver.match(spark, sf), "fixture_id")


@query("s16_export_with_split", """SELECT CASE WHEN season < 1999 THEN 'TRAIN' WHEN season = 1999 THEN 'VALIDATE' ELSE 'TEST' END AS ml_use, result, count(*) AS n FROM fx_match WHERE season < 2001 GROUP BY ALL""")
def s16(spark, sf):
    path = scratch_path(spark, "s16")
    split = F.when(F.col("season") < 1999, "TRAIN").when(F.col("season") == 1999, "VALIDATE").when(F.col("season") == 2000, "TEST")
    landing.export_split(silver.match(spark, sf).select("season", "fixture_id", "home_shots", "result"), path, split, "result")
    back = landing.read_csv(spark, path)
    return back.groupBy("ml_use", "result").agg(F.count(F.lit(1)).alias("n"))
