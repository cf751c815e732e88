"""Training, evaluation and batch scoring of the risk classifiers: logistic regression of MLlib, and the forest as a relation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from procurisk.config import DRIFT_THRESHOLDS, MODEL_FEATURES, MODEL_TARGET
from procurisk.functions.text import round_half_even
from procurisk.operators.forest import ForestModel
from procurisk.operators.forest import fit as fit_forest
from procurisk.operators.ranks import area_under_roc
from procurisk.session import cut_lineage

SEED = 42
TEST_TENTHS = 3
MODEL_NAMES = ("LogisticRegression", "RandomForestClassifier")
Model = PipelineModel | ForestModel


def split_bucket(key: Column) -> Column:
    """One of 1,048,576 buckets by a hash of the vendor id: the same on every run."""
    return F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("bigint")


def split_bounds(rows: DataFrame, label: str = MODEL_TARGET, tenths: int = TEST_TENTHS) -> DataFrame:
    """The last test bucket per class: (label, bound), two rows.

    The test part has three tenths of the rows, rounded up, and every class its share of them by largest
    remainder. A class fills its share bucket by bucket; the other rows of its last bucket come along, so
    copies of one vendor stay on one side. With fewer than two rows in a class the shares are not kept,
    and one bound serves both. Only the histogram over buckets is sorted, never the rows.
    """
    histogram = rows.groupBy(label, split_bucket(F.col("vendor_id")).alias("bucket")).agg(F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(1))  # two rows
    classes = histogram.groupBy(label).agg(F.sum("n").alias("size"))
    sized = classes.withColumns(
        {"total": F.sum("size").over(everything), "smallest": F.min("size").over(everything)}
    ).withColumn("wanted", F.floor((F.col("total") * tenths + 9) / 10))
    share = F.col("size") * F.col("wanted")
    shares = sized.withColumns(
        {"quota": F.floor(share / F.col("total")), "rest": F.pmod(share, F.col("total"))}
    ).withColumn("open", F.col("wanted") - F.sum("quota").over(everything))
    by_rest = F.row_number().over(everything.orderBy(F.col("rest").desc(), label))
    quotas = shares.withColumn(
        "quota", F.col("quota") + F.when(by_rest <= F.col("open"), 1).otherwise(0)
    ).select(label, "quota", "wanted", (F.col("smallest") >= 2).alias("by_class"))
    with_quota = histogram.join(F.broadcast(quotas), label)
    own = W.partitionBy(label).orderBy("bucket")
    overall = W.partitionBy("by_class").orderBy("bucket").rangeBetween(W.unboundedPreceding, 0)
    filled = with_quota.withColumns(
        {"own": F.sum("n").over(own) - F.col("n"), "overall": F.sum("n").over(overall)}
    )
    # the first bucket whose running total reaches the quota
    class_bound = F.max(F.when(F.col("own") < F.col("quota"), F.col("bucket")))
    overall_bound = F.min(F.when(F.col("overall") >= F.col("wanted"), F.col("bucket")))
    bounds = filled.groupBy(label, "by_class").agg(class_bound.alias("of_class"), overall_bound.alias("of_all"))
    lowest = F.min("of_all").over(everything)
    return bounds.select(
        label, F.coalesce(F.when(F.col("by_class"), F.col("of_class")).otherwise(lowest), F.lit(-1)).alias("bound")
    )


def with_split(rows: DataFrame, label: str = MODEL_TARGET) -> DataFrame:
    """Add ``is_test``."""
    bounds = F.broadcast(split_bounds(rows, label))  # two rows
    in_test = split_bucket(F.col("vendor_id")) <= F.col("bound")
    return rows.join(bounds, label).select(*rows.columns, in_test.alias("is_test"))


def model_input(features: DataFrame) -> DataFrame:
    """The model columns as doubles, nulls as 0, with id and label."""
    missing = [c for c in MODEL_FEATURES if c not in features.columns]
    if missing:
        raise ValueError(f"vendor features lack required model columns: {missing}")
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MODEL_FEATURES]
    label = [F.col(MODEL_TARGET).cast("int").alias(MODEL_TARGET)] if MODEL_TARGET in features.columns else []
    return features.select("vendor_id", *columns, *label)


def class_weights(rows: DataFrame, label: str = MODEL_TARGET) -> DataFrame:
    """Balanced weight per class: all rows / (2 * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # two rows
    return counts.select(
        label, "n", (total.cast("double") / (F.col("n") * 2).cast("double")).alias("weight")
    )


def check_both_classes(rows: DataFrame, label: str = MODEL_TARGET) -> None:
    if rows.select(label).distinct().limit(2).count() < 2:
        raise ValueError("Training target must contain both high-risk and non-high-risk vendors.")


def _logistic(n_train: int) -> Pipeline:
    def assembler(output: str) -> VectorAssembler:
        return VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol=output)

    # scaling by the population deviation, while the scaler divides by the sample deviation
    correction = math.sqrt(n_train / (n_train - 1)) if n_train > 1 else 1.0
    return Pipeline(
        stages=[
            assembler("_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="_scaled",
                outputCol="_features",
                scalingVec=Vectors.dense([correction] * len(MODEL_FEATURES)),
            ),
            LogisticRegression(
                featuresCol="_features",
                labelCol=MODEL_TARGET,
                weightCol="weight",
                maxIter=1000,
                # unit penalty against the summed loss; balanced weights add up to the row count
                regParam=1.0 / n_train,
                elasticNetParam=0.0,
                standardization=False,
                # far below what four decimals of a score can show
                tol=1e-12,
            ),
        ]
    )


def predict(model: Model, features: DataFrame) -> DataFrame:
    """Add ``probability_1`` and ``prediction`` to rows that have the model columns; nulls count as 0."""
    if isinstance(model, ForestModel):
        return model.transform(features)
    kept = features.columns
    inputs = features.withColumn("_kept", F.struct(*kept)).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MODEL_FEATURES}
    )
    scored = model.transform(inputs)
    return scored.select(
        "_kept.*",
        vector_to_array("probability")[1].alias("probability_1"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def _scaled(model: PipelineModel) -> list[tuple[str, Column, float]]:
    """Each feature with its scaled value and its weight; features that do not vary are 0."""
    scaler, correction, logistic = model.stages[1], model.stages[2], model.stages[3]
    fitted = zip(MODEL_FEATURES, scaler.mean, scaler.std, correction.getScalingVec(), logistic.coefficients)
    found = []
    for name, mean_, deviation, factor, weight in fitted:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        scaled = (value - float(mean_)) / float(deviation) * float(factor) if deviation > 0 else F.lit(0.0)
        found.append((name, scaled, float(weight)))
    return found


def logistic_probability(model: PipelineModel) -> Column:
    """The probability of the fitted logistic model in plain arithmetic: scale, weigh, add, squash."""
    total = F.lit(float(model.stages[3].intercept))
    for _, scaled, weight in _scaled(model):
        total = total + scaled * weight
    return 1.0 / (1.0 + F.exp(-total))


def logistic_gradient(model: PipelineModel, rows: DataFrame, label: str = MODEL_TARGET, weight: str = "weight") -> DataFrame:
    """(feature, gradient, scale): the slope of the penalised weighted loss at the fitted weights, in one aggregation over the training rows.

    At the optimum every slope is 0, and only there, since the loss is strictly convex: the proof of a fit that needs no second fit.
    ``scale`` is the sum of the absolute terms, which a slope is to be measured by. The intercept has no penalty.
    """
    apart = F.col(weight) * (logistic_probability(model) - F.col(label))
    terms = [("intercept", F.lit(1.0), 0.0), *_scaled(model)]
    sums = []
    for i, (_, scaled, penalty) in enumerate(terms):
        sums += [(F.sum(apart * scaled) + penalty).alias(f"g{i}"), (F.sum(F.abs(apart * scaled)) + abs(penalty)).alias(f"s{i}")]
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(f"g{i}").alias("gradient"), F.col(f"s{i}").alias("scale"))
        for i, (name, _, _) in enumerate(terms)
    ]
    return rows.agg(*sums).select(F.inline(F.array(*entries)))


def confusion_matrix(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows: true class; columns: number of rows predicted 0 and 1."""
    return predictions.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(prediction) == 0).alias("predicted_0"),
        F.count_if(F.col(prediction) == 1).alias("predicted_1"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classifier_metrics(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 with four decimals; 0 where a denominator is 0."""
    y, p = F.col(label), F.col(prediction)
    counts = predictions.agg(
        F.count("*").alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == p).alias("correct"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        round_half_even(_ratio(F.col("correct"), F.col("n")), 4).alias("accuracy"),
        round_half_even(_ratio(tp, tp + fp), 4).alias("precision"),
        round_half_even(_ratio(tp, tp + fn), 4).alias("recall"),
        round_half_even(_ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
    )


def class_report(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    y, p = F.col(label), F.col(prediction)
    counts = []
    for cls in (0, 1):
        counts += [
            F.count_if((y == cls) & (p == cls)).alias(f"tp_{cls}"),
            F.count_if((y != cls) & (p == cls)).alias(f"fp_{cls}"),
            F.count_if((y == cls) & (p != cls)).alias(f"fn_{cls}"),
        ]
    entries = []
    for cls in (0, 1):
        tp, fp, fn = (F.col(f"{c}_{cls}") for c in ("tp", "fp", "fn"))
        entries.append(
            F.struct(
                F.lit(cls).alias("class"),
                round_half_even(_ratio(tp, tp + fp), 4).alias("precision"),
                round_half_even(_ratio(tp, tp + fn), 4).alias("recall"),
                round_half_even(_ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
                (tp + fn).alias("support"),
            )
        )
    return predictions.agg(*counts).select(F.inline(F.array(*entries)))


def score_histogram(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )


def roc_auc(histogram: DataFrame) -> DataFrame:
    """Area under the ROC curve of the scores as they are, with four decimals; ties count half, null for a single class."""
    return area_under_roc(histogram).select(round_half_even(F.col("area"), 4).alias("roc_auc"))


def training_baseline(features: DataFrame) -> DataFrame:
    """Row count and the means of the monitored features."""
    return features.agg(
        F.count("*").alias("row_count"), *[mean(metric).alias(metric) for metric in DRIFT_THRESHOLDS]
    )


def mean(metric: str) -> Column:
    """Mean with six decimals; added as decimals, so it does not hinge on row order."""
    total = F.sum(F.col(metric).cast("decimal(38,12)")).cast("double")
    return round_half_even(F.try_divide(total, F.count(metric).cast("double")), 6)


@dataclass
class Trained:
    """Fitted models, the table of their results, and the name of the best one."""

    models: dict[str, Model]
    results: DataFrame
    champion: str


RESULT_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("train_size", T.LongType()),
        T.StructField("test_size", T.LongType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("random_state", T.IntegerType()),
    ]
)

# --- fixed values: parameters reported per model -----------------------------------------------
_PARAMETERS = {
    "LogisticRegression": {"estimator": "LogisticRegression", "class_weight": "balanced", "max_iter": "1000"},
    "RandomForestClassifier": {
        "estimator": "RandomForestClassifier",
        "n_estimators": "200",
        "max_depth": "6",
        "class_weight": "balanced",
        "random_state": str(SEED),
    },
}


def _best_result(results: DataFrame) -> Column:
    """Largest F1, then accuracy, then the first model."""
    return F.max_by("model_name", F.struct("f1", "accuracy", (-F.col("position")).alias("order")))


def train_and_compare(spark: SparkSession, features: DataFrame) -> Trained:
    """Fit both models on the training part, measure them on the rest, name the champion."""
    rows, weighted = with_split(model_input(features)).persist(), None
    try:
        check_both_classes(rows)
        train, test = rows.where(~F.col("is_test")), rows.where("is_test")
        weights = F.broadcast(class_weights(train).select(MODEL_TARGET, "weight"))  # two rows
        weighted = train.join(weights, MODEL_TARGET).persist()
        n_train, n_test = weighted.count(), test.count()
        by_class = {row[MODEL_TARGET]: row["weight"] for row in weights.collect()}  # two rows
        fits = {
            MODEL_NAMES[0]: lambda: _logistic(n_train).fit(weighted),
            MODEL_NAMES[1]: lambda: fit_forest(train, "vendor_id", MODEL_TARGET, MODEL_FEATURES, (by_class[0], by_class[1])),
        }
        models, lines = {}, []
        for position, (name, fit) in enumerate(fits.items()):
            model = fit()
            scored = cut_lineage(predict(model, test).select(MODEL_TARGET, "probability_1", "prediction"))
            # one row of four numbers, and one of one
            metrics = classifier_metrics(scored, MODEL_TARGET).first()
            area = roc_auc(score_histogram(scored, MODEL_TARGET, "probability_1")).first()[0]
            models[name] = model
            lines.append(
                (position, name, *metrics, area, _PARAMETERS[name], n_train, n_test, len(MODEL_FEATURES), SEED)
            )
    finally:
        for held in (weighted, rows):
            if held is not None:
                held.unpersist()
    results = spark.createDataFrame(lines, RESULT_SCHEMA)
    champion = results.agg(_best_result(results)).first()[0]
    return Trained(models, results, champion)
