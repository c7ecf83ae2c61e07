"""Exploratory tables: the numbers behind utilisation, mortality and lab charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import age_bin, lenient_number
from wardlens.operators.ordered import exact_percentiles, null_safe_join, over_all
from wardlens.operators.shape import (
    pivot_means,
    trim_outliers,
)
from wardlens.session import cut_lineage


def stays_by_hour(icustays: DataFrame, peak: float = 0.9) -> DataFrame:
    """Hour x unit stay counts (0 where absent) with a flag for cells near the largest count."""
    timed = icustays.dropna(subset=["icustay_id", "intime", "first_careunit"])
    found = timed.groupBy(F.hour("intime").alias("hour"), "first_careunit").agg(F.count(F.lit(1)).alias("n"))
    hours = found.agg(F.array_sort(F.collect_set("hour"))).scalar()
    every = found.select("first_careunit").distinct().select(F.explode(hours).alias("hour"), "first_careunit")
    cells = every.join(found, ["hour", "first_careunit"], "left").select(
        "hour", "first_careunit", F.coalesce("n", F.lit(0)).alias("stays")
    )
    top = over_all(F.max("stays"))
    return cells.withColumn("is_peak", F.col("stays") >= top * F.lit(peak)).orderBy(
        "hour", "first_careunit"
    )


def stay_trend(icustays: DataFrame) -> DataFrame:
    """Mean length of stay per year and unit, and volume rescaled to the same range."""
    grouped = icustays.groupBy(F.year("intime").alias("year"), "first_careunit").agg(
        F.avg("los").alias("mean_los"), F.count("icustay_id").alias("stays")
    )
    scale = over_all(F.max("mean_los")) / over_all(F.max("stays"))
    return grouped.withColumn("scaled_volume", F.col("stays") * scale).orderBy("year", "first_careunit")


def outcome_by_insurance(admissions: DataFrame) -> DataFrame:
    return (
        admissions.groupBy("insurance")
        .agg(
            F.avg("hospital_expire_flag").alias("mortality_rate"),
            F.count(F.lit(1)).alias("total_patients"),
        )
        .withColumn("survival_rate", 1 - F.col("mortality_rate"))
        .orderBy("mortality_rate", "insurance")
    )


def lab_matrix(
    labevents: DataFrame, labitems: DataFrame, admissions: DataFrame, labels: list[str]
) -> DataFrame:
    """Mean lab value per admission, one column per label, with the outcome."""
    readings = (
        labevents.where(F.col("value").isNotNull() & F.col("hadm_id").isNotNull())
        .join(labitems.where(F.col("label").isin(labels)), "itemid")
        .select("hadm_id", "label", lenient_number("value").alias("number"))
    )
    return pivot_means(readings, "hadm_id", "label", "number", labels).join(
        admissions.select("hadm_id", F.col("hospital_expire_flag").alias("mortality")), "hadm_id", "left"
    )


def top_labels(labevents: DataFrame, labitems: DataFrame, k: int = 5) -> list[str]:
    """Labels with most events; events are counted per item before the dictionary join."""
    per_item = labevents.groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        per_item.join(labitems, "itemid")
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(k)
        .collect()
    )
    return [r["label"] for r in rows]


def trimmed_lab_matrix(
    labevents: DataFrame, labitems: DataFrame, admissions: DataFrame, k: int = 5
) -> tuple[DataFrame, list[str]]:
    labels = top_labels(labevents, labitems, k)
    matrix = cut_lineage(lab_matrix(labevents, labitems, admissions, labels))
    return trim_outliers(matrix, labels), labels


def pair_correlations(matrix: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Correlation of every column pair within each outcome class."""
    pairs = list(combinations(columns, 2))
    wide = matrix.groupBy(outcome).agg(
        *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
        F.count(F.lit(1)).alias("n"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(outcome, "n", F.inline(cells))


def histograms(matrix: DataFrame, columns: list[str], outcome: str, bins: int = 10) -> DataFrame:
    """Equal-width bin counts per column and outcome class; the top edge joins the last bin."""
    long = matrix.select(outcome, *columns).unpivot(outcome, columns, "column", "value")
    long = long.where(F.col("value").isNotNull())
    ranges = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    bin_no = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return (
        long.join(ranges, "column")
        .groupBy(outcome, "column", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _stays_with_context(admissions: DataFrame, icustays: DataFrame) -> DataFrame:
    counts = admissions.groupBy("subject_id").agg(F.count("hadm_id").alias("readmission_count"))
    return (
        admissions.select("hadm_id", "subject_id", "insurance")
        .join(icustays.select("hadm_id", "los"), "hadm_id", "left")
        .join(counts, "subject_id", "left")
        .select(
            "insurance",
            "los",
            age_bin(F.col("subject_id") % 100).alias("age_group"),
            F.when(F.col("readmission_count") > 1, "Readmitted")
            .otherwise("First-Time")
            .alias("readmission_status"),
        )
    )


def stay_spread(admissions: DataFrame, icustays: DataFrame, by: list[str]) -> DataFrame:
    """Length-of-stay quartiles, mean and count per group; groups without a stay have NULLs."""
    counted = cut_lineage(
        _stays_with_context(admissions, icustays).groupBy(*by, "los").agg(F.count("los").alias("n"))
    )
    means = counted.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("los") * F.col("n")), F.sum("n")).alias("mean_los"), F.sum("n").alias("stays")
    )
    quartiles = exact_percentiles(counted, "los", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, weight="n", counted=True)
    return null_safe_join(means, quartiles, by, "left")
