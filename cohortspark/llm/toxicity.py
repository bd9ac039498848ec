"""Toxicity by a classifier chain of linear models.

The categories of the label table are predicted one after the other. Every model sees the words of the text and the
probabilities of the categories before it; in training these come from models that have not seen the row (out of fold).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import no_null, unwrapped
from cohortspark.llm.registry import query, read
from cohortspark.session import durable

CATEGORIES = ("quality", "toxic")
TARGET = "toxic"
SAMPLE = 10_000
VOCABULARY = 2_048
FOLDS = 3
LEAST_DOCS = 3
PENALTY = 3e-5
ITERATIONS = 30
TOLERANCE = 1e-5
PREFIXES = (4, 5, 6)
CUTOFF = 0.5


@dataclass(frozen=True)
class Chain:
    """A fitted chain: the vocabulary and one model per category; no models where there were no labelled rows."""

    vocabulary: tuple[str, ...]
    categories: tuple[str, ...]
    models: tuple[LogisticRegressionModel, ...]


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters of the whole text, and the beginnings of the longer ones (``abc_``)."""
    whole = F.array_remove(F.array_distinct(F.split(F.lower(no_null(text)), r"[^\p{L}]+")), "")
    return F.flatten(F.transform(F.array(whole), lambda w: F.concat(w, *[_beginnings(w, n) for n in PREFIXES])))


def _beginnings(whole: Column, length: int) -> Column:
    return F.array_distinct(F.transform(F.filter(whole, lambda w: F.length(w) > length), lambda w: F.concat(F.left(w, F.lit(length)), F.lit("_"))))


def sample_labelled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], bound: int) -> DataFrame:
    """``doc, fold, terms`` and the categories (0.0/1.0) of at most ``bound`` labelled documents, the same on each run.

    Ids are drawn by hash among the labels that are not null; a doc_id with several labels counts as their largest.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(
        *[F.max(F.col(c).cast("double")).alias(c) for c in categories]).dropna()
    drawn = known.orderBy(F.xxhash64("doc", F.lit("sample")), "doc").limit(bound)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    # At most ``bound`` ids, so their broadcast is bounded too.
    rows = texts.join(F.broadcast(durable(drawn)), F.col("_id") == F.col("doc")).groupBy("doc", *categories).agg(F.max("text").alias("text"))
    return durable(rows.select("doc", F.pmod(F.xxhash64("doc", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), terms(F.col("text")).alias("terms"), *categories))


def telling_terms(rows: DataFrame, categories: Sequence[str], size: int) -> list[str]:
    """The ``size`` terms of the sample that say most about the categories, by the G statistic of term against label."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = totals["n"]
    if not n:
        return []
    counts = rows.select(F.explode("terms").alias("term"), *categories).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), *[F.sum(c).alias(c) for c in categories]).where(F.col("df") >= LEAST_DOCS).persist()

    def part(seen: Column, row: Column, col: float) -> Column:
        return F.when((seen > 0) & (row > 0) & F.lit(col > 0), seen * F.log(seen * n / (row * (col or 1.0)))).otherwise(0.0)

    def g(c: str) -> Column:
        with_, pos, df = F.col(c), float(totals[c]), F.col("df")
        return part(with_, df, pos) + part(df - with_, df, n - pos) + part(pos - with_, n - df, pos) + part(n - df - pos + with_, n - df, n - pos)

    ranked = [counts.orderBy(g(c).desc(), "term").limit(-(-size // len(categories))).select("term") for c in categories]
    found = sorted({r["term"] for frame in ranked for r in frame.collect()})
    counts.unpersist()
    return found


def _features(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="terms", outputCol="x").setBinary(True).transform(rows)


def _with_earlier(rows: DataFrame, earlier: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=["x", *[f"p_{c}" for c in earlier]], outputCol="features").transform(rows)


def _fit(rows: DataFrame, category: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol=category, maxIter=ITERATIONS, regParam=PENALTY, elasticNetParam=0.0, standardization=False, tol=TOLERANCE,
                              probabilityCol="probability", predictionCol="prediction", rawPredictionCol="raw").fit(rows)


def _predict(model: LogisticRegressionModel, rows: DataFrame, category: str) -> DataFrame:
    out = model.transform(rows)
    # A sample of one class leaves a model with one probability or two, by the class.
    p = vector_to_array("probability")
    return out.withColumn(f"p_{category}", F.when(F.size(p) > 1, F.get(p, 1)).otherwise(0.0)).drop("raw", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, sample: int = SAMPLE,
        vocabulary: int = VOCABULARY) -> Chain:
    """Fits the chain on at most ``sample`` labelled documents and ``vocabulary`` terms (both bounds, at every size)."""
    rows = sample_labelled(docs, labels, categories, sample)
    words = telling_terms(rows, categories, vocabulary)
    if not words:
        return Chain((), tuple(categories), ())
    train = _features(rows, words).drop("terms").coalesce(6).persist()
    models = []
    try:
        for k, category in enumerate(categories):
            ready = _with_earlier(train, categories[:k])
            models.append(_fit(ready, category))
            if k + 1 == len(categories):
                break
            held_out = [_predict(_fit(ready.where(F.col("fold") != f), category), ready.where(F.col("fold") == f), category) for f in range(FOLDS)]
            whole = held_out[0]
            for h in held_out[1:]:
                whole = whole.unionByName(h)
            before, train = train, whole.drop("features").persist()
            train.count()
            before.unpersist()
    finally:
        train.unpersist()
    return Chain(tuple(words), tuple(categories), tuple(models))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with a probability ``p_<category>`` (0 without a fitted model) for each category, from the whole text.

    Input columns of these names give way. A null or empty text scores by the intercepts alone.
    """
    names = [f"p_{c}" for c in chain.categories]
    rows = docs.select(F.struct("*").alias("row"), terms(F.col("text")).alias("terms"))
    if not chain.models:
        return unwrapped(rows, docs.columns, **{n: F.lit(0.0) for n in names})
    out = _features(rows, chain.vocabulary).drop("terms")
    for k, (category, model) in enumerate(zip(chain.categories, chain.models, strict=True)):
        out = _predict(model, _with_earlier(out, chain.categories[:k]), category).drop("features")
    return unwrapped(out, docs.columns, **{n: n for n in names})


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the documents whose probability of ``TARGET`` reaches the cutoff; columns unchanged."""
    inner = docs.select(F.struct("*").alias("held"), "text")
    scored = score(inner, fit(docs, labels)).where(F.col(f"p_{TARGET}") < cutoff)
    return scored.select("held.*")


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], (F.col(f"p_{TARGET}") >= CUTOFF).alias("toxic"))
