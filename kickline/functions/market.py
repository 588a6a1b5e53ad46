"""Odds, probabilities and ratings as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("home", "draw", "away")


def overround(home: Column, draw: Column, away: Column) -> Column:
    return 1 / home + 1 / draw + 1 / away


def implied(home: Column, draw: Column, away: Column) -> dict[str, Column]:
    """Margin-free probabilities of decimal odds."""
    total = overround(home, draw, away)
    return {"home": 1 / home / total, "draw": 1 / draw / total, "away": 1 / away / total}


def choose_odds(df: DataFrame, triples: list[tuple[str, str, str]], min_coverage: float = 0.9) -> tuple[str, str, str] | None:
    """First triple, in order of preference, that is complete in more than 90 % of the rows."""
    have = [t for t in triples if all(c in df.columns for c in t)]
    if not have:
        return None
    row = df.agg(*[F.avg((F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull()).cast("double"))
                   .alias(f"c{i}") for i, (a, b, c) in enumerate(have)]).first()
    return next((t for i, t in enumerate(have) if row[i] is not None and row[i] > min_coverage), None)


def temper(ps: dict[str, Column], t: float | Column) -> dict[str, Column]:
    """Softmax of log p / T."""
    raised = {k: F.pow(p, F.lit(1.0) / t) for k, p in ps.items()}
    total = sum(raised.values(), F.lit(0.0))
    return {k: v / total for k, v in raised.items()}


def shift_draw(away: Column, draw: Column, home: Column, missing: Column, floor: float = 1e-9) -> dict[str, Column]:
    """Adds `missing` to the draw and rescales the other two in proportion, then clips and renormalises."""
    d = draw + missing
    rest = (1 - d) / (away + home)
    clipped = {k: F.least(F.greatest(v, F.lit(floor)), F.lit(1.0))
               for k, v in {"away": away * rest, "draw": d, "home": home * rest}.items()}
    total = sum(clipped.values(), F.lit(0.0))
    return {k: v / total for k, v in clipped.items()}


def logistic_expectation(a: Column, b: Column) -> Column:
    """Expected score of a against b on the 400-point scale."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


PI_BASE, PI_DAMP = 10.0, 3.0   # fixed values


def rating_to_goals(r: Column) -> Column:
    return F.signum(r) * (F.pow(F.lit(10.0), F.abs(r) / PI_BASE) - 1)


def damped_error(e: Column) -> Column:
    return PI_DAMP * F.log10(1 + e)


def expected_goal_difference(home_rating: Column, away_rating: Column) -> Column:
    return rating_to_goals(home_rating) - rating_to_goals(away_rating)
