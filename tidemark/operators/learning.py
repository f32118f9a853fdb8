"""Model training on feature tables with Spark ML."""

from __future__ import annotations

import hashlib
import itertools
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.performance import walk_forward_splits
from tidemark.session import cut_lineage


ROWS_PER_TASK = 50_000


def _fit(cols, estimator, train: DataFrame):
    """Fit with as many tasks as the rows fill: trees run a job per level, and a job over near-empty partitions is all overhead.
    The rows are made before: a coalesced task would hold the sorts and tables of all partitions it makes until its end."""
    made = cut_lineage(train)
    held = made.coalesce(max(1, math.ceil(made.count() / ROWS_PER_TASK))).persist()
    try:
        return _pipeline(cols, estimator).fit(held)
    finally:
        held.unpersist()


def _pipeline(cols, estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip"), estimator])


def direction_classifier(train: DataFrame, cols, trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42):
    """Boosted trees on the direction features; ``train`` has a 0/1 ``label``."""
    gbt = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return _fit(cols, gbt, train.withColumn("label", F.col("label").cast("double")))


def predict(model, rows: DataFrame) -> DataFrame:
    """Class and probability of an upward move for every row."""
    out = model.transform(rows)
    return out.withColumn("probability_up", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability")


def return_regressor(train: DataFrame, cols, target: str = "target", trees: int = 100, depth: int = 5,
                     rate: float = 0.1, validation: str | None = "is_test", seed: int = 42):
    """Boosted regression; with a validation flag training stops when it stops improving."""
    gbt = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return _fit(cols, gbt, train)


def feature_importance(model, cols, spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, importance double")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def walk_forward_scores(df: DataFrame, fit, score, n_splits: int = 5, test: int = 20, gap: int = 0,
                        method: str = "expanding", **layout) -> list[float]:
    """``fit(train) -> model`` and ``score(model, test) -> float`` on each fold in time order."""
    return scores_of_fits(df, [fit], score, n_splits, test, gap, method, **layout)[0]


def scores_of_fits(df: DataFrame, fits, score, n_splits: int = 5, test: int = 20, gap: int = 0,
                   method: str = "expanding", at_once: int = 8, **layout) -> list[list[float]]:
    """The scores of several ``fits`` on the same folds, which are made once; ``at_once`` of the fits run side by side."""
    folds = walk_forward_splits(df, n_splits, test, gap, method, **layout).persist()

    def scored(job):
        fit, i = job
        part = folds.where(F.col("fold") == i)
        return score(fit(part.where("role = 'train'")), part.where("role = 'test'"))

    try:
        folds.count()
        with ThreadPoolExecutor(at_once) as pool:
            got = list(pool.map(scored, itertools.product(fits, range(n_splits))))
    finally:
        folds.unpersist()
    return [got[i * n_splits : (i + 1) * n_splits] for i in range(len(fits))]


def summarize_scores(scores) -> dict[str, float]:
    """Mean and population deviation over the folds."""
    mean = sum(scores) / len(scores)
    return {"mean_score": mean, "std_score": math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))}


def accuracy(model, rows: DataFrame) -> float:
    got = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return float(got if got is not None else float("nan"))


def rmse(model, rows: DataFrame, target: str = "target") -> float:
    return RegressionEvaluator(labelCol=target, metricName="rmse").evaluate(model.transform(rows))


def auc(model, rows: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(rows))


CLASSIFIERS = {
    "gbt": lambda: GBTClassifier(labelCol="label", maxIter=100, maxDepth=5, stepSize=0.1, seed=42),
    "forest": lambda: RandomForestClassifier(labelCol="label", numTrees=100, maxDepth=5, seed=42),
    "logistic": lambda: LogisticRegression(labelCol="label", maxIter=100),
}
REGRESSORS = {"gbt": lambda: GBTRegressor(labelCol="target", maxIter=100, maxDepth=5, stepSize=0.1, seed=42),
              "linear": lambda: LinearRegression(labelCol="target", maxIter=100)}


def compare_models(df: DataFrame, cols, models=None, n_splits: int = 5, **kw) -> DataFrame:
    """Walk-forward accuracy of several classifiers, best mean first."""
    models = models or CLASSIFIERS
    df = df.withColumn("label", F.col("label").cast("double"))
    fits = [lambda t, m=make: _fit(cols, m(), t) for make in models.values()]
    sums = map(summarize_scores, scores_of_fits(df, fits, accuracy, n_splits, **kw))
    rows = [(name, s["mean_score"], s["std_score"]) for name, s in zip(models, sums)]
    out = df.sparkSession.createDataFrame(rows, "model string, mean_score double, std_score double")
    return rank_models(out)


def rank_models(scores: DataFrame) -> DataFrame:
    """A handful of models, hence the single window."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_score").desc(), "model")))


# The declared spaces. A kind is "int" or "float" (both ends included), "log" (uniform in the logarithm) or "choice".
SPACES = {
    "gbt": {"maxIter": ("int", 100, 1000), "maxDepth": ("int", 3, 10), "stepSize": ("log", 0.01, 0.3),
            "subsamplingRate": ("float", 0.6, 1.0), "columns": ("float", 0.6, 1.0)},
    "logistic": {"regParam": ("log", 1e-8, 10.0), "elasticNetParam": ("float", 0.0, 1.0)},
}
MAKERS = {
    "gbt": lambda columns=1.0, **p: GBTClassifier(labelCol="label", seed=42, featureSubsetStrategy=str(columns), **p),
    "logistic": lambda **p: LogisticRegression(labelCol="label", maxIter=100, **p),
}


def drawn(space: dict[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """``trials`` points of a space. A value comes from a digest of (seed, trial, name), so it is the same everywhere, and more
    trials go on where fewer have ended."""
    points = []
    for trial in range(trials):
        point = {}
        for name, (kind, *limits) in space.items():
            u = int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
            if kind == "choice":
                point[name] = limits[0][int(u * len(limits[0]))]
            elif kind == "int":
                point[name] = limits[0] + int(u * (limits[1] - limits[0] + 1))
            elif kind == "float":
                point[name] = limits[0] + u * (limits[1] - limits[0])
            elif kind == "log":
                point[name] = math.exp(math.log(limits[0]) + u * (math.log(limits[1]) - math.log(limits[0])))
            else:
                raise ValueError(f"{name}: unknown kind {kind}")
        points.append(point)
    return points


def grid(values: dict[str, list]) -> list[dict]:
    return [dict(zip(values, point)) for point in itertools.product(*values.values())]


def param_search(df: DataFrame, cols, make, points: list[dict], n_splits: int = 5, **kw) -> DataFrame:
    """Walk-forward accuracy for every point (``grid`` or ``drawn``), best mean first; ``make(**point)`` is an estimator."""
    df = df.withColumn("label", F.col("label").cast("double"))
    fits = [lambda t, p=point: _fit(cols, make(**p), t) for point in points]
    sums = map(summarize_scores, scores_of_fits(df, fits, accuracy, n_splits, **kw))
    rows = [(i, *[float(v) for v in point.values()], s["mean_score"], s["std_score"]) for i, (point, s) in enumerate(zip(points, sums))]
    schema = "trial long, " + ", ".join(f"{n} double" for n in points[0]) + ", mean_score double, std_score double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("mean_score").desc(), "trial")


def threshold_search(df: DataFrame, points: list[dict], moves: dict[int, str], returns: str = "next_return") -> DataFrame:
    """Accuracy of "up after a move above the threshold" for every point (lookback, threshold) over all rows in one pass.

    ``moves`` gives the column with the move over each lookback; the points are a literal array.
    """
    each = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(p["lookback"]).alias("lookback"), F.lit(p["threshold"]).alias("threshold"),
                              F.col(moves[p["lookback"]]).alias("move")) for i, p in enumerate(points)])
    rows = df.where(F.col(returns).isNotNull()).select(returns, F.explode(each).alias("p")).where("p.move is not null")
    hit = ((F.col("p.move") > F.col("p.threshold")) == (F.col(returns) > 0)).cast("double")
    return rows.groupBy("p.trial", "p.lookback", "p.threshold").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
