"""The append-only forecast registry: which emission governs, what repeats, what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBS = ("p_away", "p_draw", "p_home")
SAME_PROB = 1e-12   # fixed value: two probabilities this close are the same forecast

# fixed value: season, gameweek, stamp and tie number in a registry file name
FILE_NAME = r"(\d{4}-\d{2})_GW(\d{2})_(\d{8}T\d{6}Z)(?:_(\d+))?\.parquet$"


def parse_file_name(path: Column) -> Column:
    """season, gameweek, stamp and tie number, NULL for a name of another form."""
    def group(i: int) -> Column:
        return F.regexp_extract(path, FILE_NAME, i)
    return F.when(path.rlike(FILE_NAME), F.struct(
        group(1).alias("season"), group(2).cast("int").alias("gameweek"), group(3).alias("stamp"),
        F.coalesce(F.nullif(group(4), F.lit("")).try_cast("int"), F.lit(0)).alias("tie_no")))


def with_results(forecasts: DataFrame, results: DataFrame, label: str) -> DataFrame:
    """Attaches the results known so far; the hit stays NULL for unplayed matches."""
    return (forecasts.join(results, ["season", "fixture_id"], "left")
            .withColumn("hit", F.when(F.col("result").isNotNull(), F.col(label) == F.col("result"))))


def emission_list(emitted: DataFrame, group: list[str]) -> DataFrame:
    """One row per emission: its rows and the start of its gameweek."""
    return emitted.groupBy(*group, "predicted_at").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("kick").alias("_start"))


def governing(emitted: DataFrame, group: list[str]) -> DataFrame:
    """Per group: the last emission before the cut-off, else the earliest, flagged as late."""
    e = emission_list(emitted, group)
    start = e.groupBy(*group).agg(F.min("_start").alias("start"))
    e = e.drop("_start").join(start, group)
    timely = F.col("predicted_at") < F.col("start")
    return (e.groupBy(*group)
            .agg(F.max(F.when(timely, F.col("predicted_at"))).alias("_last_timely"),
                 F.min("predicted_at").alias("_first"), F.count(F.lit(1)).alias("n_emissions"))
            .select(*group, F.coalesce("_last_timely", "_first").alias("predicted_at"),
                    F.col("_last_timely").isNotNull().alias("pre_deadline"), "n_emissions"))


def governing_rows(emitted: DataFrame, group: list[str]) -> DataFrame:
    return emitted.join(governing(emitted, group), [*group, "predicted_at"])


def latest(emitted: DataFrame, group: list[str]) -> DataFrame:
    return emission_list(emitted, group).groupBy(*group).agg(F.max("predicted_at").alias("predicted_at"))


def repeats(emitted: DataFrame, group: list[str], keys: list[str], identity: list[str]) -> DataFrame:
    """Per emission: does it say exactly what the emission before it says?

    Same identity columns (model, feature set), same keys, probabilities within
    1e-12. Each emission is compared with its predecessor only.
    """
    from pyspark.sql import Window
    heads = emission_list(emitted, [*group, *identity]).drop("_start")
    w = Window.partitionBy(*group).orderBy("predicted_at", *identity)
    chain = heads.select(
        *group, "predicted_at", "n_rows", *identity, F.lag("predicted_at").over(w).alias("_prev"),
        F.lag("n_rows").over(w).alias("_prev_rows"),
        *[F.lag(c).over(w).alias(f"_prev_{c}") for c in identity])
    prev = emitted.select(*group, *keys, F.col("predicted_at").alias("_prev"),
                          *[F.col(c).alias(f"_prev_{c}") for c in identity],
                          *[F.col(p).alias(f"_prev_{p}") for p in PROBS])
    near = F.lit(True)
    for p in PROBS:
        near = near & (F.abs(F.col(p) - F.col(f"_prev_{p}")) <= SAME_PROB)
    same = (emitted.select(*group, *keys, "predicted_at", *identity, *PROBS)
            .join(chain.drop("n_rows", "_prev_rows"), [*group, "predicted_at", *identity])
            .join(prev, [*group, *keys, "_prev", *[f"_prev_{c}" for c in identity]])
            .groupBy(*group, "predicted_at", *identity)
            .agg(F.count_if(near).alias("_same")))
    equal_id = F.lit(True)
    for c in identity:
        equal_id = equal_id & F.col(c).eqNullSafe(F.col(f"_prev_{c}"))
    return (chain.join(same, [*group, "predicted_at", *identity], "left")
            .select(*group, *identity, "predicted_at", "n_rows",
                    F.coalesce(equal_id & (F.col("n_rows") == F.col("_prev_rows"))
                               & (F.col("_same") == F.col("n_rows")), F.lit(False)).alias("repeated")))


def append_new(emitted: DataFrame, group: list[str], keys: list[str], identity: list[str]) -> DataFrame:
    """The rows worth registering: emissions that repeat their predecessor are left out."""
    keep = repeats(emitted, group, keys, identity).filter(~F.col("repeated")).select(*group, *identity, "predicted_at")
    return emitted.join(keep, [*group, *identity, "predicted_at"], "left_semi")


def cleanup_plan(emitted: DataFrame, group: list[str], production_model: str) -> DataFrame:
    """Per emission: what a clean-up would do.

    Of the production model's emissions the governing one stays (marked when it
    is late) and the rest go, together with the other models'. A gameweek without
    any emission of that model is left alone with a warning.
    """
    gov = governing(emitted.filter(F.col("model") == production_model), group).select(
        *group, F.col("predicted_at").alias("_gov"), "pre_deadline")
    e = emission_list(emitted, [*group, "model"]).drop("_start")
    chosen = (F.col("model") == production_model) & (F.col("predicted_at") == F.col("_gov"))
    return (e.join(gov, group, "left")
            .withColumn("action", F.when(F.col("_gov").isNull(), "warn").when(~chosen, "drop")
                        .when(F.col("pre_deadline"), "keep").otherwise("keep_late"))
            .drop("_gov", "pre_deadline"))


MODEL_META = "model string, version string, n_features int, feature_set_version string, built_at bigint"
REJECTED = "model string, version string, outcome string, reason string, at bigint"


def model_inventory(meta: DataFrame, pointers: DataFrame, files: DataFrame) -> DataFrame:
    """One row per model version: its metadata, whether production points at it, and its model files.

    A version can be served only if it has a file; papers alone do not make a model.
    """
    own = files.groupBy("model", "version").agg(F.count(F.lit(1)).alias("n_files"))
    live = pointers.select("model", "version", F.lit(True).alias("production")).distinct()
    return (meta.join(live, ["model", "version"], "left").join(own, ["model", "version"], "left")
            .withColumns({"production": F.coalesce("production", F.lit(False)), "n_files": F.coalesce("n_files", F.lit(0))})
            .withColumn("servable", F.col("n_files") > 0))


def log_rejections(attempts: DataFrame, path: str) -> None:
    """Appends candidates that were not promoted, with the reason; earlier lines stay."""
    rows = attempts.select("model", "version", F.lit("rejected").alias("outcome"), "reason", "at")
    rows.write.mode("append").json(path)


def rejections(spark, path: str) -> DataFrame:
    return spark.read.schema(REJECTED).json(path)
