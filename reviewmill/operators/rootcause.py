"""Root-cause rules, class weights, threshold sweep, report and the multi-label classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import text as tx

THRESHOLDS = [30, 35, 40, 45, 50]
WIDE_THRESHOLDS = [25, *THRESHOLDS]


def rule_scores(text: Column) -> list[Column]:
    """0.3 per distinct phrase of the first rule set, at most 1.0."""
    return [
        F.least(F.lit(1.0), F.round(tx.count_present(text, phrases) * F.lit(0.3), 10)).alias(label)
        for label, phrases in vocab.RULES_V1.items()
    ]


def rule_percents(text: Column) -> list[Column]:
    """20 percent per distinct phrase of the second rule set, at most 100.

    A phrase counts if it is in the text or among the extracted issues; extracted issues are parts of the same text,
    so the substring test decides both.
    """
    return [
        F.least(F.lit(100), tx.count_present(text, phrases) * 20).alias(label)
        for label, phrases in vocab.RULES_V2.items()
    ]


def class_weights(labelled: DataFrame) -> DataFrame:
    """Negatives per positive for each label, kept within 1..15."""
    sums = labelled.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in vocab.LABELS))
    pairs = ", ".join(f"'{c}', {c}" for c in vocab.LABELS)
    positives = F.col("positives")
    weight = (F.col("n") - positives) / F.greatest(positives, F.lit(1))
    return sums.selectExpr("n", f"stack({len(vocab.LABELS)}, {pairs}) AS (label, positives)").select(
        "label", tx.clip(weight, 1.0, 15.0).alias("weight")
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def threshold_sweep(predictions: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """Macro-F1 per threshold over (label, y, prob_pct) rows.

    All thresholds are counted in one pass, as columns; rows are never multiplied.
    """
    hit, actual = F.col("prob_pct"), F.col("y") == 1
    counts = predictions.groupBy("label").agg(
        *(F.count_if((hit >= t) & actual).alias(f"tp{t}") for t in thresholds),
        *(F.count_if((hit >= t) & ~actual).alias(f"fp{t}") for t in thresholds),
        F.count_if(actual).alias("positives"),
    )
    long = counts.select(
        "label",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(t).alias("threshold"), F.col(f"tp{t}").alias("tp"), F.col(f"fp{t}").alias("fp"))
                    for t in thresholds
                )
            )
        ).alias("x"),
        "positives",
    ).select("label", "x.*", (F.col("positives") - F.col("x.tp")).alias("fn"))
    return long.groupBy("threshold").agg(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the best macro-F1, the smallest on ties; 50 if nothing scores above 0."""
    order = F.when(F.col("macro_f1") > 0, F.struct(F.round("macro_f1", 12), -F.col("threshold")))
    return sweep.agg(
        F.coalesce(F.max_by("threshold", order), F.lit(50)).alias("threshold"),
        F.coalesce(F.max_by("macro_f1", order), F.lit(0.0)).alias("macro_f1"),
    )


def report(predictions: DataFrame, threshold: int = 50) -> DataFrame:
    """Precision, recall, F1 and support per label, and a "macro avg" row; division by zero gives 0."""
    predicted, actual = F.col("prob_pct") >= threshold, F.col("y") == 1
    counts = predictions.groupBy("label").agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = counts.select(
        "label",
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        (tp + fn).alias("support"),
    )
    # Every label row also counts for "macro avg", so one grouping of ten rows gives both.
    both = rows.withColumn("label", F.explode(F.array("label", F.lit("macro avg"))))
    return both.groupBy("label").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )


def text_features(dims: int = 1 << 14) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=tx.WORD, gaps=False),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=dims),
            IDF(inputCol="tf", outputCol="features"),
        ]
    )


def fit_classifier(
    labelled: DataFrame, dims: int = 1 << 14, max_iter: int = 20
) -> tuple[PipelineModel, dict[str, LogisticRegressionModel]]:
    """TF-IDF and one weighted logistic regression per label; positives weigh as in ``class_weights``."""
    rows = labelled.withColumn("text", F.coalesce("text", F.lit("")))
    text_model = text_features(dims).fit(rows)
    weights = {row["label"]: row["weight"] for row in class_weights(rows).collect()}
    train = text_model.transform(rows).select("features", *vocab.LABELS).persist()
    models = {}
    for label in vocab.LABELS:
        weighted = train.select(
            "features",
            F.col(label).cast("double").alias("label"),
            F.when(F.col(label) == 1, F.lit(weights[label])).otherwise(F.lit(1.0)).alias("weight"),
        )
        models[label] = LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=0.01).fit(weighted)
    train.unpersist()
    return text_model, models


def predict(text_model: PipelineModel, models: dict[str, LogisticRegressionModel], rows: DataFrame) -> DataFrame:
    """Long predictions (id, label, y, prob_pct) of all five labels."""
    scored = text_model.transform(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    scored = scored.select("id", "features", *vocab.LABELS)
    for label, model in models.items():
        named = model.copy().setFeaturesCol("features").setProbabilityCol("p").setRawPredictionCol("r").setPredictionCol("c")
        scored = named.transform(scored).withColumn(f"p_{label}", vector_to_array("p")[1]).drop("p", "r", "c")
    pairs = ", ".join(f"'{c}', {c}, p_{c} * 100" for c in vocab.LABELS)
    return scored.selectExpr("id", f"stack({len(vocab.LABELS)}, {pairs}) AS (label, y, prob_pct)")
