"""Classifiers on feature tables, fitted by Spark ML on the executors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators.shape import fill_medians, scale_standard
from wardlens.plans.features import class_weights
from wardlens.session import cut_lineage

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def forest(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    trees: int = 100,
    depth: int = 20,
    min_leaf: int = 1,
    balanced: bool = False,
    seed: int = 42,
) -> PipelineModel:
    """Random forest; ``balanced`` weights classes inversely to their frequency."""
    if balanced:
        train = train.join(class_weights(train, label), label)
    model = RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        seed=seed,
    )
    if balanced:
        model = model.setWeightCol("weight")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(train)


def with_probability(model: PipelineModel, df: DataFrame, name: str = "p", keep: list[str] | None = None) -> DataFrame:
    """Probability of class 1 for each row."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*(keep or df.columns), name)


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """One row per feature, most important first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def loss_history(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Objective value per training round of the last stage."""
    summary = model.stages[-1].summary
    history = (summary() if callable(summary) else summary).objectiveHistory
    return spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(history)], "round int, loss double"
    )


def prepared(df: DataFrame, features: list[str], standard: bool = False) -> DataFrame:
    """Median-filled (and optionally standardised) features as doubles.

    The input is read several times here and once per training round later, so its lineage is cut.
    """
    df = cut_lineage(df)
    filled = fill_medians(df, features)
    return scale_standard(filled, features) if standard else filled


# ---- sequences --------------------------------------------------------------


def sequence_vectors(scaled: DataFrame, features: list[str]) -> DataFrame:
    """Steps of a stay side by side as one vector, in step order."""
    step = F.struct(F.col("step"), *[F.col(c) for c in features])
    ordered = F.array_sort(F.collect_list(step))
    flat = F.flatten(F.transform(ordered, lambda s: F.array(*[s[c] for c in features])))
    return (
        scaled.groupBy("icustay_id", "label")
        .agg(flat.alias("v"))
        .select("icustay_id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    )


def sequence_classifier(
    train: DataFrame, width: int, hidden: tuple[int, ...] = (64,), rounds: int = 100, seed: int = 42
) -> PipelineModel:
    net = MultilayerPerceptronClassifier(
        layers=[width, *hidden, 2], maxIter=rounds, seed=seed, featuresCol="features", labelCol="label"
    )
    return Pipeline(stages=[net]).fit(train)


# ---- text -------------------------------------------------------------------


def text_stages(dims: int, text: str = "text", out: str = "text_vector") -> list:
    """Tokens, hashed counts, inverse document frequency."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dims),
        IDF(inputCol="_counts", outputCol=out),
    ]


def fused_classifier(
    train: DataFrame,
    structured: list[str],
    label: str = "label",
    dims: int = 256,
    hidden: tuple[int, ...] = (64,),
    rounds: int = 50,
    seed: int = 42,
) -> PipelineModel:
    """Text vector and structured features side by side into one network."""
    return Pipeline(
        stages=[
            *text_stages(dims),
            VectorAssembler(inputCols=["text_vector", *structured], outputCol="features"),
            MultilayerPerceptronClassifier(
                layers=[dims + len(structured), *hidden, 2], maxIter=rounds, seed=seed, labelCol=label
            ),
        ]
    ).fit(train)


def note_classifier(train: DataFrame, label: str = "label", dims: int = 1 << 12, rounds: int = 50) -> PipelineModel:
    return Pipeline(
        stages=[
            *text_stages(dims),
            LogisticRegression(featuresCol="text_vector", labelCol=label, maxIter=rounds, regParam=0.01),
        ]
    ).fit(train)


def accuracy_by_side(scored: DataFrame, label: str, score: str, side: str = "is_test") -> DataFrame:
    """Accuracy on training and held-out rows."""
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("int")
    return scored.groupBy(side).agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"))


def score_with_default_vector(
    scored_vectors: DataFrame, vector: str, dims: int
) -> DataFrame:
    """Cases without a vector take the element-wise mean of all vectors."""
    means = scored_vectors.agg(
        F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dims)])
    ).scalar()
    return scored_vectors.withColumn("_mean", means).withColumn(
        vector, F.coalesce(F.col(vector).cast("array<double>"), F.col("_mean"))
    ).drop("_mean")


