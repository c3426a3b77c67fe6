"""Failure ranker: split, training, scoring, global importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row
from tritmarts.functions.written import written
from tritmarts.operators.labels import within
from tritmarts.settings import Modelling
from tritmarts.sources.literal import inline_table

BUCKETS = 1_000_000


def sample_bucket() -> Column:
    """Stable bucket of a channel-day, independent of row order and layout."""
    text = F.concat_ws("|", F.col("channel_id").cast("string"), F.col("d").cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint"), F.lit(BUCKETS))


def _between(first: str, last: str) -> Column:
    return F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def temporal_split(features: DataFrame, cfg: Modelling = Modelling()) -> DataFrame:
    """Train and test rows by period, in column ``part``.

    Every positive is trained on; negatives are thinned by hash to the wanted
    number per positive.  The rate comes from a one-row aggregate.
    """
    train, test = _between(cfg.train_from, cfg.train_to), _between(cfg.test_from, cfg.test_to)
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    rate = F.least(pos * cfg.negatives_per_positive, neg) / F.nullif(neg, F.lit(0))
    limit = features.filter(train).agg(F.floor(rate * BUCKETS).alias("_limit"))
    part = F.when(train, F.lit("train")).when(test, F.lit("test"))
    rows = features.withColumn("part", part).filter(F.col("part").isNotNull())
    return (with_row(rows, limit)
            .filter((F.col("part") == "test") | (F.col("y") == 1) | (sample_bucket() < F.col("_limit")))
            .drop("_limit"))


def prepare(features: DataFrame, missing: float = Modelling.missing) -> DataFrame:
    """No gaps: NULL, NaN and infinities become one impossible value.

    One short test for all of them: code of 20 columns that grows past 8,000 bytes in one method is never compiled by the JVM.
    """
    def filled(name: str) -> Column:
        x = F.col(name).cast("double")
        # NaN is above every number; of NULL nothing is known
        return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(missing)).alias(name)

    other = [c for c in features.columns if c not in fv.FEATURE_NAMES]
    return features.select(*other, *map(filled, fv.FEATURE_NAMES))


def assemble(prepared: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=fv.FEATURE_NAMES, outputCol="features").transform(prepared)


def balanced(train: DataFrame) -> DataFrame:
    """Class weights n / (2 * n_class) as column ``weight``."""
    counts = train.groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    weights = (with_row(counts, counts.agg(F.sum("_c").alias("_n")))
               .select("y", (F.col("_n") / (2.0 * F.col("_c"))).alias("weight")))
    return train.join(F.broadcast(weights), "y")  # one row per class


def _blank(train: DataFrame, n: int) -> DataFrame:
    """n equal negatives, for a period without rows to learn from: every model of them scores 0."""
    return train.sparkSession.range(n).select(
        *[F.lit(Modelling.missing).alias(name) for name in fv.FEATURE_NAMES], F.lit(0).alias("y"))


#: both classes, also where the rows hold only one
_CLASSES = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}


def train_forest(train: DataFrame, cfg: Modelling = Modelling()) -> RandomForestClassificationModel:
    """Class-balanced random forest on prepared rows.

    Rows keep the node they have reached in each tree, so that no level walks the trees from
    the root again or sends them along with its tasks.  A period without failures has no rows
    (``temporal_split`` keeps so many negatives per positive): its trees are single leaves of share 0.
    """
    blank = train.isEmpty()
    rows = balanced(assemble(_blank(train, cfg.min_leaf) if blank else train)).select(
        "features", F.col("y").cast("double").alias("y", metadata=_CLASSES), "weight")
    return RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", numTrees=cfg.trees, maxDepth=cfg.depth,
        minInstancesPerNode=cfg.min_leaf, featureSubsetStrategy="sqrt", seed=cfg.seed,
        maxMemoryInMB=1024, cacheNodeIds=True, bootstrap=not blank).fit(rows)


def train_linear(train: DataFrame) -> PipelineModel:
    """Standardised, class-balanced logistic regression as the control model; without rows its score is 0."""
    known = _blank(train, Modelling.min_leaf) if train.isEmpty() else train
    rows = balanced(assemble(known)).select("features", F.col("y").cast("double").alias("y"), "weight")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=200,
                             standardization=False, regParam=1e-6)
    return Pipeline(stages=[scale, fit]).fit(rows)


def horizon_matrix(features: DataFrame, horizon_days: Sequence[int], cfg: Modelling = Modelling()) -> DataFrame:
    """One prepared matrix for all horizons, from features whose y is the days to the next failure.

    Per horizon of n days a label ``y_n`` and, in ``train_n``, whether the row is
    trained on: the split and the thinning of ``temporal_split`` for that label.
    The rates of all horizons come from one aggregate of one row.  The rows of both periods are
    written before: the rates read only their labels, and the code of features and choice
    together would be too long for the JVM to compile.
    """
    train, test = _between(cfg.train_from, cfg.train_to), _between(cfg.test_from, cfg.test_to)
    hits = {n: within(F.col("y"), n) for n in horizon_days}

    def limit(hit: Column) -> Column:
        pos, neg = F.count_if(hit == 1), F.count_if(hit == 0)
        rate = F.least(pos * cfg.negatives_per_positive, neg) / F.nullif(neg, F.lit(0))
        return F.floor(rate * BUCKETS)

    rows = written(features.filter(train | test), "horizon_rows")
    limits = rows.filter(train).agg(*[limit(hit).alias(f"_limit_{n}") for n, hit in hits.items()])
    bucket = F.col("_bucket")
    told = with_row(rows.withColumn("_bucket", F.when(train, sample_bucket())), limits).select(
        "channel_id", "d", *fv.FEATURE_NAMES, test.alias("is_test"), *[hit.alias(f"y_{n}") for n, hit in hits.items()],
        *[(train & ((hit == 1) | (bucket < F.col(f"_limit_{n}")))).alias(f"train_{n}") for n, hit in hits.items()])
    wanted = F.col("is_test")
    for n in horizon_days:
        wanted = wanted | F.coalesce(F.col(f"train_{n}"), F.lit(False))
    return prepare(told.filter(wanted), cfg.missing)


def horizon_sweep(features: DataFrame, horizon_days: Sequence[int], cfg: Modelling = Modelling(),
                  train: Callable[[DataFrame, Modelling], object] | None = None) -> dict[int, DataFrame]:
    """Scored test rows (channel_id, d, y, score) per horizon, one forest each, all from one written matrix.

    The forests are fitted side by side: a level of a forest over a thinned sample is too small
    a job to fill a cluster.
    """
    fit = train or train_forest
    matrix = written(horizon_matrix(features, horizon_days, cfg), "horizon_matrix")

    def one(n: int) -> DataFrame:
        rows = matrix.withColumnRenamed(f"y_{n}", "y")
        part = rows.filter(f"train_{n}").select("channel_id", "d", "y", *fv.FEATURE_NAMES).persist()
        model = fit(part, cfg)
        part.unpersist()
        test = rows.filter("is_test").select("channel_id", "d", "y", *fv.FEATURE_NAMES)
        return written(score(model, test).select("channel_id", "d", "y", "score"), f"scored_horizon_{n}")

    with ThreadPool(len(horizon_days)) as pool:
        return dict(zip(horizon_days, pool.map(inheritable_thread_target(features.sparkSession)(one), horizon_days)))


def save_model(model: RandomForestClassificationModel, path: str) -> None:
    """Write a trained forest, so that later days are scored without training again."""
    model.write().overwrite().save(path)


def load_model(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def score(model, prepared: DataFrame) -> DataFrame:
    """Probability of failure as ``score``."""
    out = model.transform(assemble(prepared))
    extra = [c for c in out.columns if c in ("rawPrediction", "prediction", "probability", "scaled", "features")]
    return out.withColumn("score", vector_to_array("probability")[1]).drop(*extra)


def linear_score(model: PipelineModel) -> Column:
    """Score of the control model as an expression over prepared features, from its scale and weights alone."""
    scale, fit = model.stages
    total = F.lit(float(fit.intercept))
    for name, weight, mean, std in zip(fv.FEATURE_NAMES, fit.coefficients.toArray(), scale.mean.toArray(), scale.std.toArray()):
        if std > 0:
            total = total + F.lit(float(weight)) * (F.col(name) - F.lit(float(mean))) / F.lit(float(std))
    return 1.0 / (1.0 + F.exp(-total))


def feature_importance(model: RandomForestClassificationModel, like: DataFrame) -> DataFrame:
    """Global importance per feature; ``like`` only lends its session."""
    rows = [(n, float(v)) for n, v in zip(fv.FEATURE_NAMES, model.featureImportances.toArray())]
    return inline_table(like.sparkSession, rows, ["feature", "importance"])
