"""Three-class forecasts with MLlib: every learner returns the training frame's keys and
p_away, p_draw, p_home on the frame it is asked to score."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kickline.functions import goals
from kickline.operators import compare as cmp
from kickline.operators import scoring as sc
from kickline.operators.joins import sized_broadcast
from kickline.operators.quantiles import medians
from kickline.session import stage

CL = sc.CLASSES
PROBS = [f"p_{c}" for c in CL]


def frame(gold: DataFrame, features: list[str], target: str = "target", keep: list[str] | None = None) -> DataFrame:
    """Numeric features as doubles and the encoded label; unknown labels fail."""
    bad = sc.unknown_labels(gold, target)
    if not bad.isEmpty():
        raise sc.UnknownLabel(f"labels outside {CL}: {[r[0] for r in bad.limit(10).collect()]}")
    keep = keep or ["season", "gameweek", "fixture_id", "cutoff", "home_goals", "away_goals"]
    return gold.select(*keep, F.col(target).alias("result"), sc.encode(F.col(target)).cast("double").alias("label"),
                       *[F.col(f).cast("double").alias(f) for f in features if f not in keep])


def _prepare(features: list[str], scale: bool) -> list:
    filled = [f"{f}__f" for f in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled),
             VectorAssembler(inputCols=filled, outputCol="raw_features" if scale else "features")]
    if scale:
        steps.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return steps


def prepare(train: DataFrame, features: list[str], scale: bool) -> PipelineModel:
    """The preparing steps fitted on the training rows. The imputer sees the columns' medians as its one row: its own search sorts
    every value as an object."""
    impute, *rest = _prepare(features, scale)
    middle = medians(train, features)
    filled = impute.fit(train.sparkSession.createDataFrame([tuple(middle[f] for f in features)], ", ".join(f"`{f}` double" for f in features)))
    return PipelineModel(stages=[filled, *Pipeline(stages=rest).fit(filled.transform(train)).stages])


Prepared = tuple[PipelineModel, DataFrame]


@contextmanager
def assembled(train: DataFrame, features: list[str], scale: bool, prepared: Prepared | None = None, keep: tuple[str, ...] = ("label",)) -> Iterator[Prepared]:
    """The preparing steps fitted on the training rows, and those rows as a vector beside the columns to `keep`.

    A learner passes over its rows many times, so they are worked out once and kept while it fits, in memory or else on the executors'
    disks. Their partitions and order stay, and so do seeded draws. Fits on the same rows share them through `prepared`.
    """
    if prepared is not None:
        yield prepared
        return
    prep = prepare(train, features, scale)
    rows = prep.transform(train).select(*keep, "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield prep, rows
    finally:
        rows.unpersist()


def _unpack(df: DataFrame, vector: Column) -> DataFrame:
    out = df.withColumn("_v", vector)
    return out.withColumns({p: F.col("_v")[i] for i, p in enumerate(PROBS)}).drop("_v")


KEEP = ["season", "gameweek", "fixture_id", "result"]


def _scored(df: DataFrame, vector: Column) -> DataFrame:
    return _unpack(df, vector).select(*KEEP, *PROBS)


# -- learners: (train, test, features, seed) -> scored test ------------------------------------------

def logistic(train, test, features, seed=42, max_iter=60, reg=0.01, weight: str | None = None, prepared: Prepared | None = None):
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg)
    if weight:
        lr = lr.setWeightCol(weight)
    with assembled(train, features, True, prepared, ("label", weight) if weight else ("label",)) as (prep, rows):
        model = lr.fit(rows)
    return _scored(model.transform(prep.transform(test)), vector_to_array("probability"))


def fit_forest(train, features, seed=42, trees=30, depth=6, prepared: Prepared | None = None) -> PipelineModel:
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, subsamplingRate=0.8, minInstancesPerNode=5)
    with assembled(train, features, False, prepared) as (prep, rows):
        return PipelineModel(stages=[*prep.stages, rf.fit(rows)])


def forest(train, test, features, seed=42, trees=30, depth=6, prepared: Prepared | None = None):
    model = fit_forest(train, features, seed, trees, depth, prepared)
    return _scored(model.transform(test), vector_to_array("probability"))


def boosted(train, test, features, seed=42, rounds=10, depth=3):
    """One boosted model per class; the margins become probabilities that sum to one."""
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, seed=seed, stepSize=0.1)
    prep = prepare(train, features, False)
    ovr = OneVsRest(classifier=gbt, parallelism=3).fit(prep.transform(train))
    scored = ovr.transform(prep.transform(test))
    margins = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(margins, F.lit(0.0), lambda a, x: a + x)
    return _scored(scored, F.transform(margins, lambda m: m / total))


# fixed values: the boosted setting that training starts from
BOOST = {"rounds": 2000, "depth": 3, "step": 0.03, "bins": 64, "leaf": 10, "rows": 0.8, "columns": "0.5"}


def _booster(seed: int, rounds: int, **own) -> GBTClassifier:
    b = BOOST | own
    return GBTClassifier(maxIter=rounds, maxDepth=b["depth"], maxBins=b["bins"], minInstancesPerNode=b["leaf"], stepSize=b["step"],
                         subsamplingRate=b["rows"], featureSubsetStrategy=b["columns"], seed=seed, featuresCol="features", labelCol="_one")


def _per_class(fitted: DataFrame, make: Callable[[], GBTClassifier]) -> list:
    """One boosted model per class on the same assembled rows, side by side."""
    one = lambda i: make().fit(fitted.withColumn("_one", (F.col("label") == i).cast("double")))
    return parallel([functools.partial(one, i) for i in range(len(CL))], len(CL))


ROWS_PER_TASK = 24_000   # a round is a few short jobs: tasks with fewer rows cost more to start than to run


def _boosting_rows(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """Assembled rows, written once, in no more tasks than their number asks for."""
    rows = stage(prep.transform(df).select("label", "features"), "boosting")
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK)))


def early_stop(train: DataFrame, valid: DataFrame, features: list[str], seed: int = 42, patience: int = 100, **own) -> tuple[int, list[float]]:
    """The number of rounds with the least validation loss, and that loss after every round.

    Both tables are assembled once. The loss is the sum over the classes' models, which share one stop: a run ends
    when the least loss is `patience` rounds old or the limit is reached, and the stop is read from the last run alone. One that
    has not ended is repeated: with twice the rounds if its loss was still falling at its end, else with those the patience
    asks for, a quarter more at least.
    """
    prep = prepare(train, features, False)
    fitted, held = (_boosting_rows(prep, x) for x in (train, valid))
    limit = own.pop("rounds", BOOST["rounds"])
    rounds = min(limit, patience + max(1, patience // 4))
    while True:
        models = _per_class(fitted, lambda: _booster(seed, rounds, **own))
        losses = parallel([functools.partial(m.evaluateEachIteration, held.withColumn("_one", (F.col("label") == i).cast("double"))) for i, m in enumerate(models)], len(CL))
        total = [sum(x) for x in zip(*losses)]
        best = min(range(len(total)), key=lambda i: (total[i], i)) + 1
        if rounds >= limit or rounds >= best + patience:
            return best, total
        falling = best > rounds - max(1, patience // 4)
        rounds = min(limit, 2 * rounds if falling else max(best + patience, -(-5 * rounds // 4)))


def boosted_for(train: DataFrame, test: DataFrame, features: list[str], rounds: int, seed: int = 42, **own) -> DataFrame:
    """Boosted models per class for a fixed number of rounds; the margins become probabilities that sum to one."""
    prep = prepare(train, features, False)
    fitted = _boosting_rows(prep, train)
    scored = prep.transform(test)
    for i, m in enumerate(_per_class(fitted, lambda: _booster(seed, rounds, **own))):
        m = m.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        scored = m.transform(scored)
    each = F.array(*[vector_to_array(f"_p{i}")[1] for i in range(len(CL))])
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return _scored(scored, F.transform(each, lambda p: p / total))


def boosted_early(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], seed: int = 42, patience: int = 100, **own) -> tuple[DataFrame, int, list[float]]:
    """Rounds chosen on the validation rows, then a refit on all training rows with that number."""
    rounds, losses = early_stop(train, valid, features, seed, patience, **own)
    own.pop("rounds", None)
    return boosted_for(train.unionByName(valid), test, features, rounds, seed, **own), rounds, losses


def poisson_goals(train, test, features, seed=42, rho: float = 0.0):
    """Two Poisson regressions for the goals of each side, then the score grid."""
    with assembled(train, features, True, keep=("home_goals", "away_goals")) as (prep, fitted):   # every step of the two fits reads all rows
        scored = prep.transform(test)
        for side in ("home", "away"):
            glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol=f"{side}_goals",
                                              predictionCol=f"lam_{side}", maxIter=15, regParam=0.01)
            scored = glm.fit(fitted).transform(scored)
    return goals.with_outcome_probs(scored, "lam_home", "lam_away", rho).select(*KEEP, *PROBS)


def exact_score(train, test, features, seed=42, min_share: float = 0.02):
    """Classifies the score; scores rarer than `min_share` are pooled by result; sums back to 1X2."""
    n = train.count()
    label = F.concat_ws("-", "home_goals", "away_goals")
    freq = train.groupBy(label.alias("_score")).agg(F.count(F.lit(1)).alias("_n"))
    common = freq.filter(F.col("_n") >= min_share * n).select("_score", F.lit(True).alias("_common"))
    tagged = (train.withColumn("_score", label).join(F.broadcast(common), "_score", "left")   # at most 1 / min_share rows
              .withColumn("bucket", F.concat_ws(":", "result", F.when(F.col("_common"), F.col("_score")).otherwise("other"))))
    index = StringIndexer(inputCol="bucket", outputCol="score_label", stringOrderType="alphabetAsc")
    rf = RandomForestClassifier(labelCol="score_label", numTrees=25, maxDepth=6, maxBins=64, seed=seed)
    with assembled(tagged, features, False, keep=("bucket",)) as (prep, rows):
        indexed = index.fit(rows)
        model = rf.fit(indexed.transform(rows))
    v = vector_to_array(F.col("probability"))
    of = {c: [i for i, lbl in enumerate(indexed.labels) if lbl.startswith(f"{c}:")] for c in CL}
    summed = F.array(*[sum((v[i] for i in of[c]), F.lit(0.0)) for c in CL])
    return _scored(model.transform(prep.transform(test)), summed)


def ordinal(train, test, features, seed=42, prepared: Prepared | None = None):
    """Two cumulative binary models; the second may not exceed the first."""
    with assembled(train, features, True, prepared) as (prep, fitted):
        scored = prep.transform(test)
        for name, cond in (("_gt0", F.col("label") > 0), ("_gt1", F.col("label") > 1)):
            lr = LogisticRegression(labelCol=name, maxIter=60, regParam=0.01, probabilityCol=f"prob{name}",
                                    rawPredictionCol=f"raw{name}", predictionCol=f"pred{name}")
            scored = lr.fit(fitted.withColumn(name, cond.cast("double"))).transform(scored)
    a = vector_to_array("prob_gt0")[1]
    b = F.least(vector_to_array("prob_gt1")[1], a)
    return _scored(scored, F.array(1 - a, a - b, b))


def neural(train, test, features, seed=42, max_iter=40):
    net = MultilayerPerceptronClassifier(layers=[len(features), 64, 32, 3], maxIter=max_iter, seed=seed)
    prep = prepare(train, features, True)
    model = PipelineModel(stages=[*prep.stages, net.fit(prep.transform(train))])   # keeps its rows itself
    return _scored(model.transform(test), vector_to_array("probability"))


LEARNERS: dict[str, Callable] = {
    "logistic": logistic, "forest": forest, "boosted": boosted, "poisson": poisson_goals,
    "exact_score": exact_score, "ordinal": ordinal, "neural": neural}


# -- evaluation --------------------------------------------------------------------------------------

def quality(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """n, accuracy, log-loss and ranked probability score."""
    p = sc.probs("p")
    return scored.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg((sc.argmax_class(*p) == F.col("result")).cast("double")).alias("accuracy"),
        F.avg(sc.log_loss_term(sc.prob_of(F.col("result"), *p))).alias("log_loss"),
        F.avg(sc.rps_term(F.col("result"), *p)).alias("rps"))


def average(scored: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of several models' probabilities, renormalised."""
    weights = weights or [1.0] * len(scored)
    tagged = [d.select(*KEEP, *[(F.col(p) * w).alias(p) for p in PROBS]) for d, w in zip(scored, weights)]
    summed = functools.reduce(DataFrame.unionByName, tagged).groupBy(*KEEP).agg(*[F.sum(p).alias(p) for p in PROBS])
    total = sum((F.col(p) for p in PROBS), F.lit(0.0))
    return summed.select(*KEEP, *[(F.col(p) / total).alias(p) for p in PROBS])


def seed_average(learner: Callable, train, test, features, seeds: list[int], scale: bool = False, **kw) -> DataFrame:
    """`scale` as the learner has it: all seeds fit on the same assembled rows, side by side."""
    with assembled(train, features, scale) as prepared:
        return average(parallel([functools.partial(learner, train, test, features, seed=s, prepared=prepared, **kw) for s in seeds]))


def best_rounds(train, valid, features, grid: list[int]) -> tuple[int, list[tuple[int, float]]]:
    """Rounds with the least validation log-loss."""
    losses = [(r, quality(boosted(train, valid, features, rounds=r)).first().log_loss) for r in grid]
    return min(losses, key=lambda x: (x[1], x[0]))[0], losses


def parallel(jobs: list[Callable], threads: int = 4) -> list:
    """Independent fits side by side; each is a Spark job of its own."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def walk_forward(data: DataFrame, features: list[str], season: int, learner: Callable = logistic, min_rows: int = 200,
                 threads: int = 8, **kw) -> DataFrame:
    """Each gameweek of a season is scored by a model fitted on rows with an earlier cut-off."""
    weeks = [r.cutoff for r in data.filter(F.col("season") == season).select("cutoff").distinct().orderBy("cutoff").collect()]

    def one(cutoff: int):
        past = data.filter((F.col("cutoff") < cutoff) & F.col("label").isNotNull())
        if past.limit(min_rows).count() < min_rows:
            return None
        week = data.filter((F.col("cutoff") == cutoff) & F.col("label").isNotNull())
        return learner(past, week, features, **kw)

    done = [d for d in parallel([functools.partial(one, c) for c in weeks], threads) if d is not None]
    return functools.reduce(DataFrame.unionByName, done)


def temporal_folds(cutoffs: DataFrame, n: int) -> DataFrame:
    """Distinct cut-offs cut into n + 1 runs in time order; run 0 only trains, run k validates fold k."""
    w = Window.orderBy("cutoff")   # one row per gameweek
    return cutoffs.select("cutoff").distinct().withColumn("fold", F.ntile(n + 1).over(w) - 1)


def fold_losses(data: DataFrame, folds: DataFrame, n: int, fit: Callable) -> list[float]:
    tagged = data.join(sized_broadcast(folds), "cutoff").filter(F.col("label").isNotNull())
    return [quality(fit(tagged.filter(F.col("fold") < k), tagged.filter(F.col("fold") == k))).first().log_loss
            for k in range(1, n + 1)]


def random_search(data: DataFrame, features: list[str], folds: DataFrame, n: int, points: list[dict]) -> DataFrame:
    """Each point's mean and population deviation of the log-loss over the folds, best first."""
    def score(point: dict) -> tuple:
        losses = fold_losses(data, folds, n, lambda tr, te: logistic(tr, te, features, **point))
        mean = sum(losses) / len(losses)
        return str(point), mean, (sum((x - mean) ** 2 for x in losses) / len(losses)) ** 0.5
    rows = parallel([functools.partial(score, p) for p in points])
    return data.sparkSession.createDataFrame(rows, "params string, mean_log_loss double, sd_log_loss double").orderBy("mean_log_loss")


def temperature_grid(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Log-loss per temperature, all temperatures in one aggregation."""
    from kickline.functions.market import temper
    x = scored.select("result", *PROBS, F.explode(F.array(*[F.lit(t) for t in grid])).alias("temperature"))
    t = temper({c: F.col(f"p_{c}") for c in CL}, F.col("temperature"))
    loss = sc.log_loss_term(sc.prob_of(F.col("result"), t["away"], t["draw"], t["home"]))
    return x.groupBy("temperature").agg(F.avg(loss).alias("log_loss"))


def balanced_weights(train: DataFrame) -> DataFrame:
    """Adds a weight inversely proportional to the class frequency."""
    n = train.agg(F.count(F.lit(1)).alias("_all"))
    per = train.groupBy("label").agg(F.count(F.lit(1)).alias("_k")).crossJoin(n)
    return train.join(F.broadcast(per), "label").withColumn("weight", F.col("_all") / (3 * F.col("_k"))).drop("_all", "_k")   # three classes


def importance(train: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    model = fit_forest(train, features, seed)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return train.sparkSession.createDataFrame(list(zip(features, imp)), "feature string, importance double")


def enlarge(df: DataFrame, copies: int, features: list[str], noise: float = 0.05, seed: int = 7) -> DataFrame:
    """A draw with replacement of about `copies` times the rows, for scale tests.

    Every feature gets Gaussian noise of `noise` times its own standard deviation.
    """
    spread = df.agg(*[F.coalesce(F.stddev(f), F.lit(0.0)).alias(f"_sd_{f}") for f in features])   # one row
    drawn = df.sample(withReplacement=True, fraction=float(copies), seed=seed).crossJoin(F.broadcast(spread))
    noisy = {f: F.col(f) + noise * F.col(f"_sd_{f}") * F.randn(seed + i) for i, f in enumerate(features)}
    return drawn.withColumns(noisy).drop(*[f"_sd_{f}" for f in features])


def seed_stability(train: DataFrame, test: DataFrame, features: list[str], seeds: list[int], rule) -> DataFrame:
    """The rule against production for models that differ only by seed."""
    out = None
    with assembled(train, features, False) as prepared:
        scored = [(s, forest(train, test, features, seed=s, trees=15, prepared=prepared)) for s in seeds]
    for s, d in scored:
        p = sc.probs("p")
        hits = d.select(F.lit(s).alias("seed"), (rule.label(*p) == F.col("result")).alias("a"), (sc.argmax_class(*p) == F.col("result")).alias("b"))
        t = cmp.mcnemar(hits, ["seed"], "a", "b")
        out = t if out is None else out.unionByName(t)
    return out


def score_gameweek(model: PipelineModel, gold: DataFrame, features: list[str], model_version: str, predicted_at: int) -> DataFrame:
    """Forecasts for the rows waiting for a result, looked up in the table, with their provenance."""
    from kickline.operators.decision import label_all
    waiting = gold.filter(F.col("split") == "inference")
    rows = waiting.select("season", "gameweek", "fixture_id", "home", "away", "kick", "cutoff", "feature_set_version",
                          F.col("target").alias("result"), *[F.col(f).cast("double").alias(f) for f in features])
    scored = _unpack(model.transform(rows), vector_to_array("probability"))
    out = scored.select("season", "gameweek", "fixture_id", "home", "away", "kick", "cutoff", *PROBS, "feature_set_version",
                        F.lit(model_version).alias("model_version"), F.lit(predicted_at).alias("predicted_at"))
    return label_all(out)
