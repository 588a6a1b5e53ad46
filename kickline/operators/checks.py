"""Leakage and data-quality gates: each finds the offending rows or counts; `gate` raises before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.operators.calendar import slot_of
from kickline.operators.windows import DAY_US

# fixed values: columns only known after the match
BANNED_COLUMNS = ("xP", "team_h_score", "team_a_score", "total_points", "bps", "bonus")
STALE_DAYS = 60                # fixed value
REBUILT_GRACE_HOURS = 3        # fixed value


class QualityError(AssertionError):
    pass


class LeakageError(QualityError):
    pass


def gate(bad: DataFrame, what: str, error: type[QualityError] = QualityError, shown: int = 5) -> None:
    """Raises with a count and a sample when `bad` has rows."""
    n = bad.count()
    if n:
        sample = [r.asDict() for r in bad.limit(shown).collect()]
        raise error(f"{what}: {n} rows, for example {sample}")


def after_deadline(sources: DataFrame, time: str, deadlines: DataFrame, keys: list[str], deadline: str = "deadline") -> DataFrame:
    """Source rows at or after the deadline of the target they are attached to."""
    return sources.join(deadlines, keys).filter(F.col(time) >= F.col(deadline))


def banned_columns(df: DataFrame, banned: tuple[str, ...] = BANNED_COLUMNS) -> list[str]:
    return sorted(set(banned) & set(df.columns))


def schema_difference(df: DataFrame, contract: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns."""
    return [c for c in contract if c not in df.columns], [c for c in df.columns if c not in set(contract)]


def require_contract(df: DataFrame, contract: list[str]) -> DataFrame:
    missing, extra = schema_difference(df, contract)
    if missing or extra:
        raise QualityError(f"missing {missing[:12]}, extra {extra[:12]}")
    return df.select(*contract)


def dependency_violations(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return (df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias("n_values"))
            .filter(F.col("n_values") > 1))


def used_at_or_after(df: DataFrame, used: dict[str, str], cutoff: str) -> DataFrame:
    """Per side: rows whose used history is not strictly before the cut-off."""
    return df.agg(*[F.count_if(F.col(c) >= F.col(cutoff)).alias(side) for side, c in used.items()])


def stale_rows(df: DataFrame, used: list[str], at: str, days: int = STALE_DAYS) -> DataFrame:
    """Rows whose most recent history is more than `days` whole days old, with the age."""
    latest = F.greatest(*used) if len(used) > 1 else F.col(used[0])
    return df.withColumn("age_days", F.floor((F.col(at) - latest) / DAY_US)).filter(F.col("age_days") > days)


def foreign_division(df: DataFrame, file: str, div: str, expected: str) -> DataFrame:
    """Per file: the divisions found, and whether they are exactly the expected one."""
    return (df.filter(F.col(div).isNotNull()).select(file, div).distinct().groupBy(file)
            .agg(F.sort_array(F.collect_set(div)).alias("found"))   # one entry per division
            .withColumn("ok", F.col("found") == F.array(F.lit(expected))))


def rows_available(sources: DataFrame, time: str, deadlines: DataFrame, deadline: str) -> DataFrame:
    """Per deadline: source rows strictly before it and the rest. Sources are counted per gap between deadlines, so
    only the counts are added up in order."""
    instants = [r[0] for r in deadlines.select(F.col(deadline).cast("long")).distinct().orderBy(deadline).collect() if r[0] is not None]   # one per gameweek
    per_gap = sources.groupBy(F.when(F.col(time).isNotNull(), slot_of(time, instants)).alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).collect()
    total, seen, before = sum(r["_n"] for r in per_gap), 0, []
    counts = {r["_slot"]: r["_n"] for r in per_gap}
    for i, at in enumerate(instants):
        seen += counts.get(i, 0)
        before.append((at, seen))
    known = deadlines.sparkSession.createDataFrame(before, "_at long, _seen long")
    out = deadlines.join(F.broadcast(known), F.col(deadline).cast("long") == F.col("_at"), "left")
    have = F.coalesce(F.col("_seen"), F.lit(0))
    return out.withColumns({"n_available": have, "n_later": F.lit(total).cast("long") - have}).drop("_at", "_seen")


def inference_coherence(df: DataFrame, target: str, split: str, current_season: int) -> DataFrame:
    """One row of violation counts: target present on inference rows, absent elsewhere, foreign
    season, and more than one gameweek of inference."""
    inf = F.col(split) == "inference"
    return df.agg(
        F.count_if(inf & F.col(target).isNotNull()).alias("with_target"),
        F.count_if(~inf & F.col(target).isNull()).alias("lost_target"),
        F.count_if(inf & (F.col("season") != current_season)).alias("foreign_season"),
        F.countDistinct(F.when(inf, F.struct("season", "gameweek"))).alias("inference_gameweeks"))


def freshness(last_built: Column, last_played: Column, next_cutoff: Column, now_us: int) -> Column:
    """Why the table should be rebuilt, or that it need not.

    A gameweek that started while its results are not out yet is the source's
    delay when the table was rebuilt within three hours.
    """
    passed = next_cutoff <= now_us
    recent = F.lit(now_us) - last_built < REBUILT_GRACE_HOURS * 3_600_000_000
    return (F.when(next_cutoff.isNull(), "nothing_to_predict").when(last_played >= next_cutoff, "played_past_cutoff")
            .when(passed & recent, "waiting_for_source").when(passed, "cutoff_passed").otherwise("fresh"))


def rule_table(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Long table of rule -> violations, all rules in one pass over the table."""
    agg = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return (agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r"))
            .select("r.*"))
