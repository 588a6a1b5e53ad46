"""Constraints on tables as data: rules of rows, of groups and of references, with counts and a sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.operators.checks import QualityError


@dataclass(frozen=True)
class Rule:
    """`ok` (SQL) must hold for every row, or, with `by`, for every group as an aggregate; null does not hold."""
    table: str
    name: str
    ok: str
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reference:
    """The values of `columns` must exist in `target`; a null does not."""
    table: str
    name: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]


def _key(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _counted(df: DataFrame, key: Column, rules: list[Rule], oks: list[Column]) -> DataFrame:
    """One row per rule from a single aggregation over `df`."""
    bad = [~F.coalesce(ok, F.lit(False)) for ok in oks]
    aggs = [x for i, b in enumerate(bad) for x in (F.count_if(b).alias(f"n{i}"), F.min(F.when(b, key)).alias(f"s{i}"))]
    found = [F.struct(F.lit(r.table).alias("table_name"), F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("violations"), F.col(f"s{i}").alias("sample"))
             for i, r in enumerate(rules)]
    return df.agg(*aggs).select(F.explode(F.array(*found)).alias("r")).select("r.*")


def _orphans(df: DataFrame, target: DataFrame, rule: Reference) -> DataFrame:
    names = [f"_r{i}" for i in range(len(rule.columns))]
    own = df.groupBy(*[F.col(c).alias(n) for c, n in zip(rule.columns, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n"))
    have = target.select(*[F.col(c).alias(n) for c, n in zip(rule.target_columns, names, strict=True)]).distinct()
    return (own.join(have, names, "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"), F.min(_key(tuple(names))).alias("sample"))
            .select(F.lit(rule.table).alias("table_name"), F.lit(rule.name).alias("rule"), "violations", "sample"))


def violations(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], rules: list[Rule | Reference]) -> DataFrame:
    """table_name, rule, violations and sample, one row per rule.

    A violation is a row (also for references) or a group; the sample is the smallest key of one, joined
    by |: the table's `keys`, the group or the value referred to. The rules of a table's rows are one
    aggregation, those of groups by the same columns one more. An empty table violates nothing.
    """
    parts, plans = [], {}
    for r in rules:
        if isinstance(r, Reference):
            parts.append(_orphans(tables[r.table], tables[r.target], r))
        else:
            plans.setdefault((r.table, r.by), []).append(r)
    for (name, by), own in plans.items():
        df = tables[name]
        if by:
            grouped = df.groupBy(*by).agg(*[F.expr(r.ok).alias(f"_ok{i}") for i, r in enumerate(own)])
            parts.append(_counted(grouped, _key(by), own, [F.col(f"_ok{i}") for i in range(len(own))]))
        else:
            parts.append(_counted(df, _key(keys[name]), own, [F.expr(r.ok) for r in own]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def require(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], rules: list[Rule | Reference]) -> None:
    """Raises with every violated rule, its count and its sample."""
    bad = violations(tables, keys, rules).filter("violations > 0").orderBy("table_name", "rule").collect()   # one row per rule
    if bad:
        raise QualityError("; ".join(f"{r.table_name}.{r.rule}: {r.violations}, for example {r['sample']}" for r in bad))
