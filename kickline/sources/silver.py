"""Match-analytics tables derived from the star-schema and event tables.

One order is one match between the nation of its first line's supplier (home)
and the nation of its customer (away). Only integer arithmetic is used, so any
engine reproduces the tables. Matches are written once per application to the
shared folder, as a Silver layer would be; the others are projections of them. The
players are not written: a reader carries only the columns it asks for through the
join, and what it groups by match needs no second exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kickline.operators.reshape import outcome, points, two_sides
from kickline.operators.windows import DAY_US
from kickline.session import compile_wide, stage, use_utc

_staged: dict[tuple[str, str, str], DataFrame] = {}

KEY = ["season", "fixture_id"]
STAT_COUNT = 23
UNPLAYED_FROM = "2001-07-01"


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp, read as UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    compile_wide(use_utc(spark))
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def gameweek_of(c: Column) -> Column:
    return (F.floor((F.dayofyear(c) - 1) / 7) + 1).cast("int")


def _build_match(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("f"))
    first = line.groupBy("l_orderkey").agg(F.min("f").alias("f")).select("l_orderkey", "f.*")
    nation = table(spark, sf, "nation")
    home = (table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("n_name").alias("home"), F.col("r_name").alias("division")))
    away = (table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_name").alias("away")))
    hg = (F.col("l_quantity").cast("long") % 6)
    ag = (F.floor("l_extendedprice").cast("long") % 5)
    pk, ck, ok, sk = F.col("l_partkey"), F.col("o_custkey"), F.col("o_orderkey"), F.col("l_suppkey")
    priced = ok % 50 != 0

    def odds(x: Column) -> Column:
        return F.when(priced, x / 10)

    return (table(spark, sf, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(home, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(away, F.col("o_custkey") == F.col("c_custkey"))
            .filter(F.col("home") != F.col("away"))
            .select(
                F.year("o_orderdate").alias("season"), gameweek_of(F.col("o_orderdate")).alias("gameweek"),
                ok.alias("fixture_id"), (micros("o_orderdate") + ok).alias("kick"),
                F.to_date("o_orderdate").alias("match_date"), "home", "away", "division",
                sk.alias("home_id"), ck.alias("away_id"),
                hg.alias("home_goals"), ag.alias("away_goals"),
                (hg + pk % 15).alias("home_shots"), (ag + ck % 13).alias("away_shots"),
                (hg + F.floor((pk % 15) / 2)).alias("home_sot"), (ag + F.floor((ck % 13) / 2)).alias("away_sot"),
                (pk % 11).alias("home_corners"), (ck % 11).alias("away_corners"),
                (sk % 17).alias("home_fouls"), (ck % 17).alias("away_fouls"),
                (sk % 4).alias("home_yellows"), (ck % 4).alias("away_yellows"),
                F.when(pk % 17 == 0, 1).otherwise(0).cast("long").alias("home_reds"),
                F.when(ck % 19 == 0, 1).otherwise(0).cast("long").alias("away_reds"),
                (1 + ok % 5).alias("fdr_home"), (1 + ck % 5).alias("fdr_away"),
                odds(12 + pk % 40).alias("odds_home"), odds(28 + ck % 15).alias("odds_draw"),
                odds(15 + ok % 50).alias("odds_away"),
                (30 + pk % 41).alias("w_home"), (15 + ck % 26).alias("w_draw"), (20 + ok % 38).alias("w_away"),
                (30 + pk % 37).alias("wb_home"), (15 + ck % 23).alias("wb_draw"), (20 + ok % 43).alias("wb_away"))
            .withColumn("result", outcome("home_goals", "away_goals")))


def match(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "match", lambda: _build_match(spark, sf))


MATCH_STATS = ["gf", "gc", "shots", "sot", "corners", "fouls", "cards"]


def team_match(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows per match, each from its own side's view."""
    m = match(spark, sf).withColumns({
        "home_cards": F.col("home_yellows") + 2 * F.col("home_reds"),
        "away_cards": F.col("away_yellows") + 2 * F.col("away_reds")})
    pairs = {"team": ("home", "away"), "rival": ("away", "home"),
             "gf": ("home_goals", "away_goals"), "gc": ("away_goals", "home_goals")}
    pairs.update({s: (f"home_{s}", f"away_{s}") for s in MATCH_STATS[2:]})
    return (two_sides(m, ["season", "gameweek", "fixture_id", "kick"], pairs)
            .withColumns({"pts": points("gf", "gc").cast("long"), "gd": F.col("gf") - F.col("gc")}))


def league_games(spark: SparkSession, sf: str) -> DataFrame:
    """Every competition of the teams of the match table, told apart by the fixture number."""
    comp = F.element_at(F.array(*[F.lit(c) for c in ("facup", "eflcup", "champions", "europa", "premier", "premier", "premier")]),
                        (F.col("fixture_id") % 7 + 1).cast("int"))
    return team_match(spark, sf).select(
        "season", F.col("fixture_id").alias("event_id"), "kick", "team", comp.alias("competition"), "gf", "gc",
        (1 + F.col("fixture_id") % 9).alias("round_weight"), F.lit(True).alias("finished"))


def club_match(spark: SparkSession, sf: str) -> DataFrame:
    """The visitor's view with the customer as the club: clubs that come and go between seasons."""
    return match(spark, sf).select(
        "season", "gameweek", "fixture_id", "kick", F.concat(F.lit("C"), F.col("away_id").cast("string")).alias("team"),
        F.col("away_goals").alias("gf"), F.col("home_goals").alias("gc"), F.col("away_shots").alias("shots"),
        points("away_goals", "home_goals").cast("long").alias("pts"))


def cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    from kickline.operators.calendar import cutoff_per_gameweek
    return cutoff_per_gameweek(match(spark, sf), "kick")


def player(spark: SparkSession, sf: str) -> DataFrame:
    m = match(spark, sf).select("season", "gameweek", "fixture_id", "kick", "home", "away",
                                "home_goals", "away_goals")
    home_side = F.col("l_linenumber") % 2 == 1
    return (table(spark, sf, "lineitem").join(m, F.col("l_orderkey") == F.col("fixture_id"))
            .select("season", "gameweek", "fixture_id", "kick",
                    F.when(home_side, F.col("home")).otherwise(F.col("away")).alias("team"),
                    F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("player"),
                    F.element_at(F.array(*[F.lit(p) for p in ("GK", "DEF", "MID", "FWD")]),
                                 (F.col("l_partkey") % 4 + 1).cast("int")).alias("position"),
                    F.least(F.lit(90), 2 * F.col("l_quantity").cast("long")).cast("long").alias("minutes"),
                    F.col("l_discount").alias("xg"), F.col("l_tax").alias("xa"),
                    (F.col("l_quantity").cast("long") % 13).alias("points"),
                    (F.col("l_suppkey") % 6).alias("saves"),
                    F.when(home_side, F.col("away_goals")).otherwise(F.col("home_goals")).alias("conceded"),
                    F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"),
                    F.col("l_suppkey").alias("supp_no"), F.col("l_extendedprice").alias("price")))


COMPETITION = {"view": "premier", "click": "facup", "signup": "eflcup", "purchase": "champions", "error": "europa"}


def competition_match(spark: SparkSession, sf: str) -> DataFrame:
    """Team rows over five competitions, from the event table."""
    k = F.get_json_object("props", "$.k").cast("long")
    comp = F.create_map(*[F.lit(x) for kv in COMPETITION.items() for x in kv])
    return table(spark, sf, "events").select(
        F.year("ts").alias("season"), F.col("event_id"), micros("ts").alias("kick"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("team"),
        F.try_element_at(comp, F.col("event_type")).alias("competition"),
        (F.floor("value").cast("long") % 5).alias("gf"), (F.col("event_id") % 4).alias("gc"),
        F.when(k % 10 != 0, k % 10).alias("round_weight"),
        (F.col("event_id") % 50 != 0).alias("finished"))


def week_start(c: Column) -> Column:
    """Monday 00:00 UTC of the week that holds the instant, in microseconds."""
    day = F.floor(c / DAY_US)
    return (day - F.pmod(day + 3, F.lit(7))) * DAY_US


def competition_objectives(spark: SparkSession, sf: str) -> DataFrame:
    c = competition_match(spark, sf)
    return (c.select("team", week_start(F.col("kick")).alias("cutoff")).distinct()
            .withColumn("season", F.year(F.timestamp_micros("cutoff"))))


def valuation(spark: SparkSession, sf: str) -> DataFrame:
    """One valuation per order: player, club, line, day and value in cents."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("valuation_id"),
        micros("o_orderdate").alias("day"),
        F.concat(F.lit("N"), (F.col("o_orderkey") % 25).cast("string")).alias("club"),
        F.element_at(F.array(*[F.lit(x) for x in ("gk", "def", "mid", "fwd")]),
                     (F.col("o_custkey") % 4 + 1).cast("int")).alias("line"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic probabilities of two models, with result and odds."""
    a = F.col("w_home") + F.col("w_draw") + F.col("w_away")
    b = F.col("wb_home") + F.col("wb_draw") + F.col("wb_away")
    return match(spark, sf).select(
        "season", "gameweek", "fixture_id", "kick", "home", "away", "result",
        *[(F.col(f"w_{c}") / a).alias(f"p_{c}") for c in ("away", "draw", "home")],
        *[(F.col(f"wb_{c}") / b).alias(f"q_{c}") for c in ("away", "draw", "home")],
        "odds_away", "odds_draw", "odds_home")


def emissions(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three dated emissions of every gameweek's forecast; the middle one is model B's."""
    cut = cutoffs(spark, sf)
    gw = F.col("gameweek")
    times = (cut.select("season", "gameweek", "cutoff", F.explode(F.array(
        F.when(gw % 5 != 0, F.struct(F.lit("m1").alias("model"), (F.col("cutoff") - 2 * DAY_US).alias("predicted_at"))),
        F.when(gw % 3 != 0, F.struct(F.lit("m2").alias("model"), (F.col("cutoff") - 3_600_000_000).alias("predicted_at"))),
        F.struct(F.lit("m1").alias("model"), (F.col("cutoff") + DAY_US).alias("predicted_at")))).alias("e"))
        .filter(F.col("e").isNotNull()).select("season", "gameweek", "cutoff", "e.*"))
    f = forecast(spark, sf)
    b = F.col("model") == "m2"
    return (f.join(times, ["season", "gameweek"])
            .select("season", "gameweek", "fixture_id", "kick", "cutoff", "model", "predicted_at",
                    *[F.when(b, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
                      for c in ("away", "draw", "home")]))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Landing manifests: one snapshot per event, with rejected, empty and absent entry lists."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.year("ts").alias("season"),
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("dataset"),
        micros("ts").alias("stamp"),
        F.when(e % 11 == 0, F.lit(None)).when(e % 13 == 0, F.array().cast("array<struct<rejected:boolean>>"))
        .otherwise(F.array(F.struct((e % 3 == 0).alias("rejected")),
                           F.struct((e % 5 != 0).alias("rejected")))).alias("entries"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Raw club names with case, punctuation and suffix noise, one per supplier."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey") % 6
    clean = F.regexp_replace("n_name", "_", " ")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("raw_id"),
                    F.when(k == 0, F.upper(clean)).when(k == 1, F.concat(F.lit(" "), clean, F.lit(" Utd.")))
                    .when(k == 2, F.concat(clean, F.lit(" Town FC"))).when(k == 3, F.regexp_replace(clean, " ", "-"))
                    .when(k == 4, F.concat(F.lit("The "), clean)).otherwise(F.concat(F.lit("N'"), F.col("s_nationkey")))
                    .alias("raw_name")))


def name_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical clubs: short code and display name."""
    return table(spark, sf, "nation").select(
        F.concat(F.lit("T"), F.col("n_nationkey")).alias("short_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.regexp_replace("n_name", "_", " "))
        .otherwise(F.concat(F.regexp_replace("n_name", "_", " "), F.lit(" City"))).alias("team_name"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Edge and application log lines."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        e, micros("ts").alias("at"), F.when(e % 2 == 0, "edge").otherwise("app").alias("kind"),
        F.when(e % 20 == 0, 500).when(e % 7 == 0, 409).otherwise(200).alias("status"),
        F.when(e % 31 == 0, F.concat(F.lit("x"), F.col("value").cast("string")))
        .otherwise(F.concat(F.col("value").cast("string"), F.lit("s"))).alias("latency"),
        "event_type", "props", F.concat(F.lit("task-"), k.cast("string")).alias("task_id"), F.col("user_id"),
        F.col("value"))


def team_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Detailed stats s00…s22 per team and match, with gaps."""
    base = two_sides(match(spark, sf), ["season", "gameweek", "fixture_id", "kick"],
                     {"team": ("home", "away"), "_s": ("home_shots", "away_shots")})
    f = F.col("fixture_id")
    return base.select("season", "gameweek", "fixture_id", "kick", "team", "is_home", *[
        F.when((f + i) % 29 != 0, (f * (i + 3) + F.col("_s") * 7 + i) % 23).alias(f"s{i:02d}")
        for i in range(STAT_COUNT)])
