"""Evaluation tables for scored cases: one or two probability columns and a 0/1 label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import RISK_LABELS, risk_bucket
from wardlens.operators.ordered import first_rows, next_row, running_totals, split_points
from wardlens.session import cut_lineage

THRESHOLD = 0.5


def predicted(score: str | Column, threshold: float = THRESHOLD, strict: bool = False) -> Column:
    """1 when the score reaches the threshold (or exceeds it, with ``strict``)."""
    s = F.col(score) if isinstance(score, str) else score
    return ((s > threshold) if strict else (s >= threshold)).cast("int")


def _rows(one_row: DataFrame, *structs: Column) -> DataFrame:
    """Turn a one-row aggregate into several rows."""
    return one_row.select(F.inline(F.array(*structs)))


# ---- counts -----------------------------------------------------------------


def confusion_matrix(df: DataFrame, label: str, pred: Column) -> DataFrame:
    """All four cells of a binary confusion matrix, empty cells 0."""
    y, p = F.col(label), pred
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    counted = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"n{a}{b}") for a, b in cells])
    return _rows(
        counted,
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"n{a}{b}").alias("n"))
            for a, b in cells
        ],
    )


def classification_report(df: DataFrame, label: str, pred: Column) -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, and accuracy.

    A zero divisor gives 0. Works for any number of classes; only pair counts are shuffled, and the
    few class rows are written out once for the averages.
    """
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), pred.cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    per_class = cut_lineage(
        pairs.select(
            F.inline(
                F.array(
                    F.struct(F.col("y").alias("class"), hit.alias("hit"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("support")),
                    F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("support")),
                )
            )
        )
        .groupBy("class")
        .agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("support").alias("support"))
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    scored = per_class.select(
        "class",
        ratio(F.col("hit"), F.col("said")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )
    total = F.sum("support")

    def weighted(c):
        return ratio(F.sum(F.col(c) * F.col("support")), total).alias(c)

    macro = scored.agg(
        F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")
    )
    by_support = scored.agg(
        F.lit("weighted avg").alias("class"), *[weighted(c) for c in ("precision", "recall", "f1")], total.alias("support")
    )
    accuracy = ratio(F.sum("hit"), total)
    overall = scored.agg(
        F.lit("accuracy").alias("class"),
        *[accuracy.alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    return scored.drop("hit").unionByName(macro).unionByName(by_support).unionByName(overall)


def accuracy(df: DataFrame, actual: str, guess: str) -> DataFrame:
    """Case-insensitive exact match rate."""
    return df.agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg((F.lower(F.col(guess)) == F.lower(F.col(actual))).cast("int")).alias("accuracy"),
    )


# ---- ranking quality --------------------------------------------------------


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; ties count half, NULL when a class is missing.

    Every positive beats the negatives with a smaller score, so running totals over distinct scores
    are enough and no pair of cases is formed.
    """
    ranked = running_totals(_by_score(df, label, score), "threshold", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )


def roc_curve(df: DataFrame, label: str, score: str, drop_collinear: bool = True) -> DataFrame:
    """ROC points by falling threshold, starting at (0, 0) with no threshold.

    ``drop_collinear`` leaves out a point when the next step adds the same counts, as it lies on a
    straight line; the highest and the lowest threshold always stay.
    """
    counts = cut_lineage(_by_score(df, label, score))
    cuts = split_points(counts, "threshold")
    ranked = running_totals(counts, "threshold", ["pos", "neg"], points=cuts)
    if drop_collinear:
        falling = ranked.withColumn("down", -F.col("threshold"))
        ranked = next_row(falling, "down", ["pos", "neg"], sorted(-c for c in cuts)).where(
            F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos"))
            | (F.col("next_neg") != F.col("neg"))
            | (
                (F.col("pos_before") + F.col("pos") == F.col("pos_all"))
                & (F.col("neg_before") + F.col("neg") == F.col("neg_all"))
            )
        )
    points = ranked.select(
        "threshold",
        F.try_divide(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
        F.try_divide(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"),
    )
    start = counts.agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


# Thresholds marked on the curve.
MARKED = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def operating_points(curve: DataFrame, marks: tuple[float, ...] = MARKED) -> DataFrame:
    """Curve point nearest to each marked threshold; of two equally near, the higher threshold."""
    nearest = curve.where(F.col("threshold").isNotNull()).agg(
        *[
            F.min_by(
                F.struct(F.lit(m).alias("mark"), "threshold", "fpr", "tpr"),
                F.struct(F.abs(F.col("threshold") - m), -F.col("threshold")),
            ).alias(f"p{i}")
            for i, m in enumerate(marks)
        ]
    )
    return _rows(nearest, *[F.col(f"p{i}") for i in range(len(marks))])


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean outcome and mean score per equal-width bin (right-closed); empty bins are left out."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    number = sum(((F.col(score) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.avg(F.col(label).cast("double")).alias("fraction_positive"),
            F.avg(score).alias("mean_score"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("bin")
    )


# ---- two models -------------------------------------------------------------


def agreement_rate(df: DataFrame, a: str, b: str, within: float = 0.2) -> DataFrame:
    close = F.abs(F.col(a) - F.col(b)) < within
    return df.agg((F.avg(close.cast("int")) * 100).alias("agreement_percent"))


def quadrants(df: DataFrame, a: str, b: str) -> DataFrame:
    counted = df.agg(
        *[
            F.count_if((predicted(a) == i) & (predicted(b) == j)).alias(f"n{i}{j}")
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    return _rows(
        counted,
        *[
            F.struct(F.lit(i).alias("first_predicts"), F.lit(j).alias("second_predicts"), F.col(f"n{i}{j}").alias("n"))
            for i in (0, 1)
            for j in (0, 1)
        ],
    )


def error_table(
    df: DataFrame, label: str, a: str, b: str, names: tuple[str, str] = ("DL", "RF")
) -> DataFrame:
    """Who was right: four categories with count and percentage, absent categories 0."""
    right_a = predicted(a) == F.col(label)
    right_b = predicted(b) == F.col(label)
    groups = {
        "Both Models Correct": right_a & right_b,
        "Both Models Wrong": ~right_a & ~right_b,
        f"Only {names[0]} Correct": right_a & ~right_b,
        f"Only {names[1]} Correct": ~right_a & right_b,
    }
    counted = df.agg(
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(groups.values())],
        F.count(F.lit(1)).alias("n"),
    )
    return _rows(
        counted,
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.col(f"n{i}").alias("n"),
                (F.try_divide(F.col(f"n{i}"), F.col("n")) * 100).alias("percentage"),
            )
            for i, name in enumerate(groups)
        ],
    )


def case_finder(
    df: DataFrame, key: str, label: str, a: str, b: str, gap: float = 0.4, names: tuple[str, str] = ("DL", "RF")
) -> DataFrame:
    """Every noteworthy case with its category: strong disagreement, false positive, false negative."""
    y = F.col(label)
    flags = {
        "Strong Disagreement": F.abs(F.col(a) - F.col(b)) > gap,
        f"{names[0]} False Positive": (predicted(a) == 1) & (y == 0),
        f"{names[0]} False Negative": (predicted(a) == 0) & (y == 1),
        f"{names[1]} False Positive": (predicted(b) == 1) & (y == 0),
        f"{names[1]} False Negative": (predicted(b) == 0) & (y == 1),
    }
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda t: t.isNotNull())
    return df.select(
        F.explode(tags).alias("case_type"),
        F.col(key),
        F.col(a),
        F.col(b),
        F.when(y == 1, "Died").otherwise("Survived").alias("outcome"),
    )


def case_studies(found: DataFrame, key: str) -> DataFrame:
    """First case of each category."""
    return first_rows(found, ["case_type"], [key], 1).drop("rn")


def auc_verdict(auc_a: DataFrame, auc_b: DataFrame, margin: float = 0.05) -> DataFrame:
    """Verdict on two one-row AUC tables and the model to prefer."""
    pair = auc_a.select(F.col("auc").alias("auc_a")).withColumn("auc_b", auc_b.select("auc").scalar())
    a, b = F.col("auc_a"), F.col("auc_b")
    return pair.select(
        "auc_a",
        "auc_b",
        F.when(a > b + margin, "first substantially better")
        .when(a > b, "first slightly better")
        .when(a < b - margin, "second substantially better")
        .when(a < b, "second slightly better")
        .otherwise("similar")
        .alias("verdict"),
        F.when(a > b, "first").otherwise("second").alias("prefer"),
    )


def compare_methods(df: DataFrame, key: str, actual: str, first: str, second: str) -> DataFrame:
    """Per case: both answers and whether each is right."""
    def same(c):
        return F.lower(F.col(c)) == F.lower(F.col(actual))

    return df.select(key, actual, first, second, same(first).alias("first_correct"), same(second).alias("second_correct"))


def method_winner(compared: DataFrame) -> DataFrame:
    a, b = F.avg(F.col("first_correct").cast("int")), F.avg(F.col("second_correct").cast("int"))
    return compared.agg(
        a.alias("first_accuracy"),
        b.alias("second_accuracy"),
        F.when(b > a, "second").when(a > b, "first").otherwise("equal").alias("winner"),
    )


# ---- risk tables ------------------------------------------------------------


def risk_stratification(df: DataFrame, label: str, score: str) -> DataFrame:
    """Count and outcome rate per risk bucket, empty buckets 0; a score of 1 is in no bucket."""
    bucket = risk_bucket(score)
    counted = df.agg(
        *[F.count_if(bucket == b).alias(f"n{i}") for i, b in enumerate(RISK_LABELS)],
        *[
            F.avg(F.when(bucket == b, F.col(label).cast("double"))).alias(f"r{i}")
            for i, b in enumerate(RISK_LABELS)
        ],
    )
    return _rows(
        counted,
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(b).alias("risk"),
                F.col(f"n{i}").alias("cases"),
                (F.coalesce(F.col(f"r{i}"), F.lit(0.0)) * 100).alias("rate_percent"),
            )
            for i, b in enumerate(RISK_LABELS)
        ],
    )


def action(score: str | Column) -> Column:
    """Recommended action of the table version: below 0.3, below 0.6, else."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s < 0.3, "Standard Care").when(s < 0.6, "Close Monitoring").otherwise("Immediate Intervention")
    )


def demo_action(score: str | Column) -> Column:
    """Recommended action of the single-case version: above 0.6, above 0.3, else."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s > 0.6, "Immediate Intervention").when(s > 0.3, "Close Monitoring").otherwise("Standard Care")
    )


def demo_category(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > 0.6, "High").when(s > 0.3, "Moderate").otherwise("Low")


def decision_table(df: DataFrame, key: str, label: str, score: str, per_band: int = 5) -> DataFrame:
    """First cases of each action band with the action, the outcome and a miss flag."""
    banded = df.where(F.col(score).isNotNull()).withColumn("recommendation", action(score))
    return first_rows(banded, ["recommendation"], [key], per_band).select(
        key,
        score,
        "recommendation",
        F.when(F.col(label) == 1, "Expired").otherwise("Survived").alias("outcome"),
        (predicted(score) != F.col(label)).alias("misclassified"),
    )


def ensemble(df: DataFrame, a: str, b: str, name: str = "p_ensemble") -> DataFrame:
    """Average of two probabilities of the same case."""
    return df.withColumn(name, (F.col(a) + F.col(b)) / 2)


# Reference ranges of the three lab columns, in column order.
LAB_RANGES = [(11.0, 16.0), (20.0, 30.0), (95.0, 105.0)]


def out_of_range(value: str | Column, lo: float | Column, hi: float | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce((v < lo) | (v > hi), F.lit(False))


def clinical_score(age: str, labs: list[str], ranges: list[tuple[float, float]] = LAB_RANGES) -> Column:
    """Age points plus at most three abnormal labs, on raw values."""
    a = F.col(age)
    points = F.when(a > 80, 4).when(a > 65, 3).when(a > 50, 2).when(a > 35, 1).otherwise(0)
    abnormal = sum(
        (out_of_range(c, *r).cast("int") for c, r in zip(labs, ranges)), F.lit(0)
    )
    return points + F.least(abnormal, F.lit(3))


def clinical_category(score: Column) -> Column:
    return (
        F.when(score >= 6, "Very High")
        .when(score >= 4, "High")
        .when(score >= 3, "Moderate")
        .when(score >= 1, "Low")
        .otherwise("Very Low")
    )


def lab_flags(labs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Long lab rows with a flag against a (itemid, lo, hi) table; items without a range are normal."""
    return labs.join(ranges, "itemid", "left").withColumn(
        "abnormal", out_of_range("valuenum", F.col("lo"), F.col("hi"))
    )


def case_summary(cases: DataFrame, scored: DataFrame, key: str, a: str, b: str, label: str) -> DataFrame:
    """Demographics, the three scores and the outcome of each scored case."""
    both = ensemble(scored.select(key, a, b, label), a, b)
    return cases.join(both, key).select(
        *cases.columns,
        a,
        b,
        "p_ensemble",
        F.when(F.col(label) == 1, "Expired").otherwise("Survived").alias("outcome"),
    )
