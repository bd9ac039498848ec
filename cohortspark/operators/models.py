"""Classifiers and regressors as ml pipelines, their scores and stored descriptions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.features import latest_row
from cohortspark.operators.ranks import one_row, running_totals
from cohortspark.session import durable

# Class weights of the positive and negative rows.
POSITIVE_WEIGHT, NEGATIVE_WEIGHT = 0.99, 0.01

# Rows that make a task of their own worth while, and the most of one task.
TASK_ROWS, MOST_TASK_ROWS = 8192, 500_000
# A fit of a forest keeps one count per row and tree: the most of one fit, and the trees of a fit above that.
FOREST_COUNTS, LOT_TREES = 64_000_000, 50


def latest_training_rows(df: DataFrame, person: str, outcome: str, encounter: str, features: Sequence[str]) -> DataFrame:
    """Last positive encounter of people who ever have the outcome, last encounter of the others, with class weights."""
    ever = df.groupBy(person).agg(F.max(outcome).alias("_ever"))
    marked = df.join(ever, person).where((F.col(outcome) == 1) | (F.col("_ever") == 0))
    last = latest_row(marked, [person], [encounter], [encounter, outcome, *features])
    weight = F.when(F.col(outcome) == 1, POSITIVE_WEIGHT).otherwise(NEGATIVE_WEIGHT)
    return last.withColumn("class_weight", weight)


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``is_test``: a reproducible split by a hash of the key, whatever the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return df.withColumn("is_test", point < test_share)


def spread(df: DataFrame) -> DataFrame:
    """Stores the rows in tasks of one size, one per core or more; up to two tasks' rows stay as they lie.

    Fits of trees pass over the rows hundreds of times, so one large task among small ones, or a few tasks on many cores, costs its time every time.
    """
    stored = durable(df)
    rows, cores = stored.count(), stored.sparkSession.sparkContext.defaultParallelism
    tasks = min(rows // TASK_ROWS, cores * -(-rows // (cores * MOST_TASK_ROWS)))
    return durable(stored.repartition(tasks)) if tasks > 1 else stored


def _assembled(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, iterations: int = 1000) -> PipelineModel:
    lr = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, tol=1e-14, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*_assembled(features), lr]).fit(df)


def coefficient_table(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, coefficient) in falling order; one row per feature."""
    rows = sorted(zip(features, map(float, model.stages[-1].coefficients)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importances(model: PipelineModel) -> np.ndarray:
    """Importance of every feature; all trees count alike, in however many forests they were fitted."""
    fitted = [s for s in model.stages if hasattr(s, "featureImportances")]
    values = [s.featureImportances.toArray() for s in fitted]
    if len(values) == 1:
        return values[0]
    total = np.average(values, axis=0, weights=[s.getNumTrees for s in fitted])
    return total / (total.sum() or 1.0)


def importance_table(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    rows = sorted(zip(features, map(float, importances(model))), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def boosted_classifier(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 3, seed: int = 1) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_assembled(features), gbt]).fit(df)


def random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 1000, depth: int = 5, seed: int = 1) -> PipelineModel:
    """A forest; for many rows it is fitted in lots of trees, whose predictions are averaged by their number of trees.

    A fit keeps a count per row and tree, and adds up bins for every node of a level of all its trees: with all trees at once the counts
    outgrow the executors' memory and the bins their caches. Lots draw from seeds farther apart than a fit has partitions.
    """
    size = trees if df.count() * trees <= FOREST_COUNTS else LOT_TREES
    lots = [min(size, trees - first) for first in range(0, trees, size)]
    scale = Pipeline(stages=_assembled(features)).fit(df)
    x = scale.transform(df)
    names = ["prediction"] if len(lots) == 1 else [f"_forest{i}" for i in range(len(lots))]
    forests = [RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol=name, numTrees=n, maxDepth=depth, seed=seed + 1_000_003 * i).fit(x)
               for i, (name, n) in enumerate(zip(names, lots))]
    mean = " + ".join(f"{n} * {name}" for name, n in zip(names, lots))
    joint = [SQLTransformer(statement=f"SELECT *, ({mean}) / {trees} AS prediction FROM __THIS__")] if len(lots) > 1 else []
    return PipelineModel([*scale.stages, *forests, *joint])


def boosted_regressor(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 3, seed: int = 1) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_assembled(features), gbt]).fit(df)


def score_of(scored: DataFrame) -> Column:
    return vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")


def _fold_of(key: Column, folds: int, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def _newton_sums(b: np.ndarray):
    """Worker of one Newton step for all folds' models ``b`` (folds x p): per model the log likelihood, its gradient and its
    curvature over the rows of the other folds, added up over a partition, as (model, place, value)."""
    folds, p = b.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((folds, 1 + p + p * p))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), pc.list_flatten(batch.column(1)).to_numpy().reshape(-1, p - 1)])
            mine, y = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float)
            margin = x @ b.T
            seen = mine[:, None] != np.arange(folds)
            chance = 0.5 * (1 + np.tanh(margin / 2))
            out[:, 0] += (seen * (y[:, None] * margin - np.logaddexp(0, margin))).sum(axis=0)
            out[:, 1:p + 1] += (seen * (y[:, None] - chance)).T @ x
            out[:, p + 1:] += (seen * chance * (1 - chance)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)
        g, i = np.divmod(np.arange(out.size), out.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(out.ravel())], ["g", "i", "v"])

    return run


def fold_models(rows: DataFrame, p: int, folds: int, steps: int = 50, tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """Logistic models without penalty, one per fold on the rows of all others: ``(coefficients, scans)``, the intercept first.

    ``rows`` has ``fold``, ``x`` (an array of p - 1 doubles) and ``y`` (0.0 or 1.0). All models take a Newton step from the sums of
    one scan; a step that does not raise a model's likelihood is halved at the next. What reaches the driver is folds x p x p.
    """
    best, at = np.zeros((folds, p)), np.zeros((folds, p))
    reached, step, done, scans = np.full(folds, -np.inf), np.zeros((folds, p)), np.zeros(folds, bool), 0
    while not done.all() and scans < steps:
        sums = np.zeros((folds, 1 + p + p * p))
        for g, i, v in rows.select("fold", "x", "y").mapInArrow(_newton_sums(at), "g int, i int, v double").groupBy("g", "i").agg(F.sum("v")).collect():
            sums[g, i] = v
        scans += 1
        for g in np.flatnonzero(~done):
            if sums[g, 0] >= reached[g] - 1e-12 * abs(sums[g, 0]):
                reached[g], best[g] = sums[g, 0], at[g]
                step[g] = np.linalg.lstsq(sums[g, p + 1:].reshape(p, p), sums[g, 1:p + 1], rcond=1e-14)[0]
            else:
                step[g] /= 2
            done[g] = np.abs(step[g]).max() < tolerance
            at[g] = best[g] + step[g]
    return best, scans


def cross_validate(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 10, seed: int = 0) -> DataFrame:
    """Accuracy of a logistic model per fold that has rows: ``fold, accuracy, n``; folds come from a hash of the key.

    The models of all folds are fitted together, with one scan of the rows per Newton step (``fold_models``).
    """
    spread = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    # On a common scale; a constant feature is left at zero.
    scaled = [(F.col(c).cast("double") - F.lit(spread[f"m{i}"])) / F.lit(spread[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    rows = durable(df.select(_fold_of(F.col(key), folds, seed).alias("fold"), F.array(*scaled).alias("x"), F.col(label).cast("double").alias("y")))
    b, _ = fold_models(rows, len(features) + 1, folds)
    mine = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in b]), F.col("fold"))
    margin = F.get("b", F.lit(0)) + F.aggregate(F.zip_with("x", F.slice("b", 2, len(features)), lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    judged = rows.withColumn("b", mine).select("fold", ((margin > 0) == (F.col("y") == 1)).cast("double").alias("right"))
    return judged.groupBy("fold").agg(F.avg("right").alias("accuracy"), F.count(F.lit(1)).alias("n"))


def score_thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positives at every distinct score, highest first (scores are counted before ordering)."""
    per = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("_p"), F.sum((F.col(label) == 0).cast("bigint")).alias("_n"))
    return running_totals(per, [], [F.col(score).desc()], {"tp": F.col("_p"), "fp": F.col("_n")})


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, average precision, squared and absolute errors and R2 of a score; null where undefined."""
    points = score_thresholds(df, score, label)
    ends = points.agg(F.max("tp").cast("double").alias("_tp"), F.max("fp").cast("double").alias("_fp"))
    area = points.agg(
        # Trapezoids: negatives at this score meet all positives above it and half of those tied with it.
        F.sum(F.col("_n") * (F.col("tp") - F.col("_p") / 2)).alias("_area"),
        F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"))
    y = F.col(label).cast("double")
    gap = y - F.col(score)
    err = df.agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop(y).alias("_vy"))
    t = one_row(ends, area, err)
    return t.select(F.try_divide("_area", F.col("_tp") * F.col("_fp")).alias("auc"), F.try_divide("_ap", "_tp").alias("average_precision"),
                    "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "_vy")).alias("r2"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """``precision`` and ``recall`` at every distinct score; recall is null without positive rows."""
    points = score_thresholds(df, score, label)
    total = points.agg(F.max("tp").alias("_all"))
    return points.join(F.broadcast(total)).select(score, (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "_all").alias("recall"))


MODELS = {"boosted_classifier": boosted_classifier, "random_forest": random_forest, "boosted_regressor": boosted_regressor}


def evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, top: int = 5, again: Sequence[str] = ("boosted_regressor",)) -> DataFrame:
    """(model, n_features, n_test, metrics): each tree model scored on rows it has not seen; the models named in ``again``
    are also fitted on their ``top`` most important features alone. The models are fitted side by side, since a fit's short
    jobs leave cores idle."""
    train, test = spread(train), spread(test)

    def scores(name: str, model: PipelineModel, n: int) -> DataFrame:
        seen = model.transform(test)
        scored = durable(seen.select(score_of(seen).alias("_s"), F.col(label).alias("_y")))
        metrics = one_row(scored.agg(F.count(F.lit(1)).alias("n_test")), ranking_metrics(scored, "_s", "_y"))
        return metrics.select(F.lit(name).alias("model"), F.lit(n).alias("n_features"), "*")

    def judged(name: str) -> list[DataFrame]:
        fit = MODELS[name]
        model = fit(train, features, label)
        out = [scores(name, model, len(features))]
        if name in again:
            order = sorted(zip(features, importances(model)), key=lambda r: (-r[1], r[0]))
            best = [f for f, _ in order[:top]]
            out.append(scores(name, fit(train, best, label), len(best)))
        return out

    with ThreadPool(len(MODELS)) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(judged), MODELS)
    return reduce(DataFrame.unionByName, [x for out in found for x in out])


def save_model(model: PipelineModel, features: Sequence[str], chi_square: DataFrame, path: str, **notes) -> None:
    """Model files, the coefficient table with each feature's test, and JSON notes, under one path."""
    spark = chi_square.sparkSession
    model.write().overwrite().save(f"{path}/model")
    coefficient_table(spark, model, features).join(chi_square, "feature", "left").write.mode("overwrite").json(f"{path}/coefficients")
    spark.createDataFrame([(json.dumps({"features": list(features), **notes}, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/notes")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    notes = json.loads(spark.read.text(f"{path}/notes").first()[0])
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/coefficients"), notes
