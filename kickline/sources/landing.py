"""The raw zone: append-only landing, snapshots and scans of what was landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM, REPLACEMENT = "\ufeff", "\ufffd"


class MissingColumns(ValueError):
    pass


class NothingLanded(FileNotFoundError):
    pass


# -- landing --------------------------------------------------------------------------------------

def write_raw(df: DataFrame, path: str, stamp: str, fmt: str = "csv", **options: str) -> str:
    """Appends under ingested_at=<stamp>; an earlier stamp is never touched."""
    target = f"{path}/ingested_at={stamp}"
    df.write.mode("append").format(fmt).options(**options).save(target)
    return target


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# -- scans ----------------------------------------------------------------------------------------

def _clean(name: str) -> str:
    return name.replace(BOM, "").strip()


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, pattern: str = "*.csv*") -> DataFrame:
    """Text columns named by the header, without a byte-order mark; bytes that do not decode are
    dropped from the values. Compressed files are read as they are."""
    df = (spark.read.option("header", True).option("encoding", "UTF-8").option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", True).csv(path))
    df = df.toDF(*[_clean(c) for c in df.columns])
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise MissingColumns(f"{path} lacks {missing}")
    return df.select(*[F.nullif(F.translate(F.col(f"`{c}`"), REPLACEMENT, ""), F.lit("")).alias(c) for c in df.columns])


def read_csv_skipping_bad_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headerless text scan. A line with too many fields is skipped, a short one is padded with NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path))
    bare = F.regexp_replace("_bad", '"[^"]*"', "")
    too_many = F.col("_bad").isNotNull() & (F.size(F.split(bare, ",")) > len(columns))
    return df.filter(~too_many).select(*columns)


def usable(df: DataFrame, required: list[str]) -> DataFrame:
    """Drops rows without teams or score."""
    return df.dropna(subset=required)


def landed_seasons(spark: SparkSession, root: str) -> list[int]:
    """The seasons that have a folder under `root`, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("season=") and n.partition("=")[2].isdigit())


def read_seasons(spark: SparkSession, root: str, seasons: list[int], file: str = "") -> DataFrame:
    """Concatenates the seasons that were landed under season=<s>; columns may differ by season."""
    out = None
    for s in seasons:
        path = f"{root}/season={s}{file}"
        if not path_exists(spark, path):
            continue
        one = read_csv(spark, path).withColumn("season", F.lit(s))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise NothingLanded(f"no season of {seasons} under {root}")
    return out


FIXTURE_PAGE = ("content array<struct<id: bigint, kickoff: struct<millis: bigint>, status: string, "
                "teams: array<struct<team: struct<id: double, name: string, club: struct<abbr: string>>, score: double>>, "
                "gameweek: struct<gameweek: int, competitionPhase: struct<label: string>>>>")


def read_fixture_pages(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """JSON pages with an array of fixtures to two team rows per fixture, each with the rival's score.

    Fixtures without a time or without two sides are left out.
    """
    pages = spark.read.schema(f"{FIXTURE_PAGE}, season int, competition string").option("multiLine", whole_files).json(path)
    fx = pages.select("season", "competition", F.explode("content").alias("x"))
    fx = fx.filter(F.col("x.kickoff.millis").isNotNull() & (F.size("x.teams") == 2))
    sides = fx.select("season", "competition", F.col("x.id").alias("fixture_id"),
                      (F.unix_micros(F.timestamp_millis("x.kickoff.millis"))).alias("kick"),
                      (F.upper("x.status") == "C").alias("finished"),
                      F.col("x.gameweek.competitionPhase.label").alias("round"),
                      F.posexplode("x.teams").alias("pos", "t"), F.col("x.teams").alias("_all"))
    rival = F.get("_all", 1 - F.col("pos"))
    return sides.select("season", "competition", "fixture_id", "kick", "finished", "round",
                        F.upper(F.trim("t.team.club.abbr")).alias("team"), (F.col("pos") == 0).alias("is_home"),
                        F.col("t.score").alias("gf"), rival["score"].alias("gc"), rival["team"]["name"].alias("rival_name"))


LIVE_PAGE = ("season int, gameweek int, elements array<struct<id: string, stats: map<string, string>, "
             "explain: array<struct<fixture: bigint>>>>")


def read_live_players(spark: SparkSession, path: str, stats: list[str]) -> DataFrame:
    """One row per player and gameweek. Whole-week totals stay on the first listed fixture, so a
    double gameweek is not counted twice; numbers sent as text are cast, bad ones become NULL."""
    pages = spark.read.schema(LIVE_PAGE).json(path)
    e = pages.select("season", "gameweek", F.explode("elements").alias("e"))
    return e.select("season", "gameweek", F.col("e.id").alias("player_id"),
                    F.get("e.explain", F.lit(0))["fixture"].alias("fixture_id"),
                    *[F.try_element_at("e.stats", F.lit(s)).try_cast("double").alias(s) for s in stats])


def live_fixture_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed fixture of a player, players without any kept."""
    pages = spark.read.schema(LIVE_PAGE).json(path)
    e = pages.select("season", "gameweek", F.explode("elements").alias("e"))
    return e.select("season", "gameweek", F.col("e.id").alias("player_id"), F.explode_outer("e.explain").alias("x")).select(
        "season", "gameweek", "player_id", F.col("x.fixture").alias("fixture_id"))


# -- snapshots ------------------------------------------------------------------------------------

def snapshot_usable(entries: Column) -> Column:
    """False only when there are entries and every one was rejected."""
    ok = F.exists(entries, lambda e: ~F.coalesce(e["rejected"], F.lit(False)))
    return entries.isNull() | (F.size(entries) == 0) | ok


def latest_usable(manifests: DataFrame, keys: list[str], stamp: str = "stamp", entries: str = "entries") -> DataFrame:
    return manifests.filter(snapshot_usable(F.col(entries))).groupBy(*keys).agg(F.max(stamp).alias(stamp))


def latest_at(manifests: DataFrame, keys: list[str], at: Column, stamp: str = "stamp") -> DataFrame:
    """Latest snapshot not after an instant; rejected ones count too."""
    return manifests.filter(F.col(stamp) <= at).groupBy(*keys).agg(F.max(stamp).alias(stamp))


# -- incremental fetch plans ----------------------------------------------------------------------

def gameweeks_to_fetch(fixtures: DataFrame, finished: Column, landed: DataFrame) -> DataFrame:
    """Finished gameweeks not landed yet, plus the one in progress of each season."""
    gw = fixtures.groupBy("season", "gameweek").agg(F.bool_and(finished).alias("_all"), F.bool_or(finished).alias("_any"))
    missing = gw.filter("_all").join(landed.select("season", "gameweek").distinct(), ["season", "gameweek"], "left_anti")
    current = gw.filter(F.col("_any") & ~F.col("_all"))
    return missing.unionByName(current).select("season", "gameweek").distinct()


def ids_to_fetch(ids: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(cached.select(key), key, "left_anti")


# -- export ---------------------------------------------------------------------------------------

def export_split(df: DataFrame, path: str, split: Column, target: str) -> DataFrame:
    """CSV with an imposed split column; rows without split or target stay out."""
    out = df.withColumn("ml_use", split).dropna(subset=["ml_use", target])
    out.write.option("header", True).csv(path)
    return out
