"""Maximum likelihood in one bounded variable.

Every trial point is one aggregation over the table; only the slope and the curvature come back. The
likelihoods here are concave, so the slope's sign brackets the maximum and Newton steps that leave
the bracket are replaced by its middle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.functions.goals import rho_bounds
from kickline.operators.scoring import CLASSES

T_MIN, T_MAX = 0.3, 5.0   # fixed values
LEAST = 1e-12             # fixed value: what a probability or a factor is clipped at


def maximise(slope: Callable[[float], tuple[float, float]], low: float, high: float, start: float,
             tolerance: float = 1e-10, most: int = 100) -> float:
    """The point of [low, high] where a concave function is largest; `slope` gives its first two derivatives.

    An end is returned if the function still rises (or already falls) there.
    """
    if slope(high)[0] >= 0:
        return high
    if slope(low)[0] <= 0:
        return low
    x = min(max(start, low), high)
    for _ in range(most):
        first, second = slope(x)
        if first == 0:
            return x
        low, high = (x, high) if first > 0 else (low, x)
        step = x - first / second if second < 0 else low
        step = step if low < step < high else (low + high) / 2
        if abs(step - x) < tolerance or high - low < tolerance:
            return step
        x = step
    raise ArithmeticError(f"no maximum found in {most} steps, bracket {low} to {high}")


def fit_rho(df: DataFrame, lam: str, mu: str, home_goals: str, away_goals: str) -> float:
    """The correction of low scores with the largest likelihood inside its bounds.

    Every row contributes log(1 + c * rho) with c known from its score and rates; rows with more than one
    goal on a side contribute nothing. 0 without such rows or without room between the bounds.
    """
    x, y = F.col(home_goals), F.col(away_goals)
    c = (F.when((x == 0) & (y == 0), -F.col(lam) * F.col(mu)).when((x == 0) & (y == 1), F.col(lam))
         .when((x == 1) & (y == 0), F.col(mu)).when((x == 1) & (y == 1), F.lit(-1.0)))
    low = df.select(c.alias("c")).filter("c IS NOT NULL")
    ends = rho_bounds(df, lam, mu).first()
    if ends.rho_min is None or ends.rho_min >= ends.rho_max or low.isEmpty():
        return 0.0

    def slope(rho: float) -> tuple[float, float]:
        term = F.col("c") / F.greatest(1 + F.col("c") * rho, F.lit(LEAST))
        r = low.agg(F.sum(term).alias("first"), (-F.sum(term * term)).alias("second")).first()
        return r.first, r.second
    return maximise(slope, ends.rho_min, ends.rho_max, 0.0)


def fit_temperature(scored: DataFrame, probs: dict[str, str], result: str, low: float = T_MIN, high: float = T_MAX) -> float:
    """The temperature with the least log-loss of `probs` (class -> column); concave in its inverse. 1 without a row.

    Rows without a result or with a missing probability take no part.
    """
    logs = {k: F.log(F.least(F.greatest(F.col(p), F.lit(LEAST)), F.lit(1.0))) for k, p in probs.items()}
    said = F.coalesce(*[F.when(F.col(result) == k, v) for k, v in logs.items()])
    rows = scored.select(said.alias("said"), *[v.alias(f"l_{k}") for k, v in logs.items()]).dropna()
    if rows.isEmpty():
        return 1.0

    def slope(b: float) -> tuple[float, float]:
        top = F.greatest(*[F.col(f"l_{k}") for k in probs])
        w = {k: F.exp((F.col(f"l_{k}") - top) * b) for k in probs}
        total = sum(w.values(), F.lit(0.0))
        mean = sum((w[k] * F.col(f"l_{k}") for k in probs), F.lit(0.0)) / total
        square = sum((w[k] * F.col(f"l_{k}") * F.col(f"l_{k}") for k in probs), F.lit(0.0)) / total
        r = rows.agg(F.avg(F.col("said") - mean).alias("first"), (-F.avg(square - mean * mean)).alias("second")).first()
        return r.first, r.second
    return 1.0 / maximise(slope, 1.0 / high, 1.0 / low, 1.0)


def class_columns(prefix: str = "p") -> dict[str, str]:
    return {c: f"{prefix}_{c}" for c in CLASSES}
