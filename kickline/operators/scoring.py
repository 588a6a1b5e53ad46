"""Scores of three-class forecasts, each a plain aggregate over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("away", "draw", "home")   # fixed order of the classes, also the order of the outcome
EPS = 1e-15                          # fixed value: probability floor of the log-loss


class UnknownLabel(ValueError):
    pass


def probs(prefix: str = "p") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}_{c}") for c in CLASSES)


def argmax_class(away: Column, draw: Column, home: Column) -> Column:
    """Most likely class; the first in class order wins ties."""
    return (F.when((away >= draw) & (away >= home), "away").when(draw >= home, "draw").otherwise("home"))


def market_argmax(away: Column, draw: Column, home: Column) -> Column:
    """Most likely class of the odds baseline: home, draw, away on ties."""
    return F.when((home >= draw) & (home >= away), "home").when(draw >= away, "draw").otherwise("away")


def prob_of(actual: Column, away: Column, draw: Column, home: Column) -> Column:
    return F.when(actual == "away", away).when(actual == "draw", draw).when(actual == "home", home)


def log_loss_term(p: Column, eps: float = EPS) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0)))


def rps_term(actual: Column, away: Column, draw: Column, home: Column) -> Column:
    """Ranked probability score of one forecast: the classes are ordered, so near misses cost less."""
    o1 = F.when(actual == "away", 1.0).otherwise(0.0)
    o2 = F.when(actual == "home", 0.0).otherwise(1.0)
    return (F.pow(away - o1, F.lit(2.0)) + F.pow(away + draw - o2, F.lit(2.0))) / 2


def confusion_counts(pred: Column, actual: Column) -> dict[str, Column]:
    return {f"n_{a}_{p}": F.count_if((actual == a) & (pred == p)) for a in CLASSES for p in CLASSES}


def class_metrics(df: DataFrame, group: list[str], pred: str, actual: str) -> DataFrame:
    """n, accuracy, macro and per-class precision, recall and F1 from one grouped pass; a zero
    denominator scores 0."""
    cm = confusion_counts(F.col(pred), F.col(actual))
    agg = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in cm.items()])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out: dict[str, Column] = {}
    for c in CLASSES:
        hit = F.col(f"n_{c}_{c}")
        said = sum((F.col(f"n_{a}_{c}") for a in CLASSES), F.lit(0))
        was = sum((F.col(f"n_{c}_{p}") for p in CLASSES), F.lit(0))
        out[f"precision_{c}"], out[f"recall_{c}"] = ratio(hit, said), ratio(hit, was)
        out[f"f1_{c}"] = ratio(2 * hit, said + was)
    acc = sum((F.col(f"n_{c}_{c}") for c in CLASSES), F.lit(0)) / F.col("n")
    macro = {f"{m}_macro": sum((out[f"{m}_{c}"] for c in CLASSES), F.lit(0.0)) / 3 for m in ("precision", "recall", "f1")}
    return agg.select(*group, "n", acc.alias("accuracy"), *[v.alias(k) for k, v in {**macro, **out}.items()])


def unknown_labels(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*CLASSES)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def encode(c: Column) -> Column:
    """Class number, NULL for an unknown label."""
    pos = F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def decode(c: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in CLASSES]), c)


def reliability(df: DataFrame, actual: str, prefix: str = "p", bins: int = 10) -> DataFrame:
    """Per class and left-closed bin: rows, mean forecast and observed frequency."""
    edges = [i / bins for i in range(1, bins)]
    long = df.select(F.col(actual).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(f"{prefix}_{c}").alias("p")) for c in CLASSES])).alias("_c")).select("_y", "_c.*")
    bin_no = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return (long.withColumn("bin", bin_no).groupBy("cls", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"),
                 F.avg((F.col("_y") == F.col("cls")).cast("double")).alias("observed")))


def auc(df: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve from grouped score counts.

    Rows are first reduced to one per distinct score, so the running count of
    negatives below a score handles ties and runs over scores, not rows.
    """
    from kickline.operators.windows import running
    per_score = (df.filter(F.col(score).isNotNull()).groupBy(*group, score)
                 .agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")))
    key = "_all"
    cum = running(per_score.withColumn(key, F.lit(1)), [key, *group], [score], sums={"_below": "_neg"})
    agg = cum.groupBy(*group).agg(
        F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2)).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return agg.select(*group, "n_pos", "n_neg",
                      F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"))
