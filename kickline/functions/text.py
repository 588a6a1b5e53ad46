"""Names: normal form, generic suffixes and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words one source appends to a club name and another does not
GENERIC_SUFFIXES = ("city", "town", "fc", "afc")


class UnmappedName(ValueError):
    pass


def normalize(c: Column) -> Column:
    """Lower case, no apostrophes or points, hyphens as spaces, `utd` spelled out, single spaces."""
    s = F.translate(F.lower(F.trim(c)), "-'.", " ")
    s = F.regexp_replace(s, r"\butd\b", "united")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_generic(c: Column) -> Column:
    """Drops generic words at the end while another word remains. Expects the normal form."""
    return F.regexp_replace(c, rf"(?<=\S)( ({'|'.join(GENERIC_SUFFIXES)}))+$", "")


def resolve_names(names: DataFrame, registry: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """raw_name -> short_name and how it was found: alias, exact, stripped, ambiguous, unresolved.

    `registry` has short_name and team_name, one row per club.
    """
    team = normalize(F.col("team_name"))
    exact = (registry.select("short_name", F.explode(F.array(team, normalize(F.col("short_name")))).alias("_norm"))
             .groupBy("_norm").agg(F.min("short_name").alias("_exact")))
    stripped = (registry.groupBy(strip_generic(team).alias("_short_norm"))
                .agg(F.min("short_name").alias("_one"), F.countDistinct("short_name").alias("_k")))
    alias = F.lit(None).cast("string")
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        alias = F.try_element_at(table, F.col("raw_name"))
    norm = normalize(F.col("raw_name"))
    return (names.select("raw_name", alias.alias("_alias"), norm.alias("_norm"), strip_generic(norm).alias("_short_norm"))
            .join(exact, "_norm", "left").join(stripped, "_short_norm", "left")
            .select("raw_name", F.col("_norm").alias("norm"),
                    F.coalesce("_alias", "_exact", F.when(F.col("_k") == 1, F.col("_one"))).alias("short_name"),
                    F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_exact").isNotNull(), "exact")
                    .when(F.col("_k") == 1, "stripped").when(F.col("_k") > 1, "ambiguous")
                    .otherwise("unresolved").alias("how")))


def require_resolved(resolved: DataFrame, shown: int = 50) -> DataFrame:
    """Fails with every name that did not resolve, not only the first."""
    bad = resolved.filter(F.col("short_name").isNull())
    n = bad.count()
    if n:
        listed = [f"{r.raw_name} ({r.how})" for r in bad.orderBy("raw_name").limit(shown).collect()]
        raise UnmappedName(f"{n} names did not resolve: {', '.join(listed)}")
    return resolved
