"""Event-time features per stay: changes, totals, labels, regular grids and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import (
    add_hours,
    completed_years,
    holds,
    hours_between,
    mixed,
    per_day,
    plausible_adult,
    rise_percent,
)
from wardlens.operators.joins import interval_join
from wardlens.operators.shape import fill_both_ways, scale_min_max
from wardlens.session import cut_lineage

# Item ids of the blood measure and of the output events, grid shape, label limits.
CREATININE_ITEMS = [50912]
URINE_ITEMS = [
    40055, 43175, 40069, 40094, 40715, 40473, 40085, 40057,
    40056, 40405, 40428, 40086, 40096, 40651, 226559,
]
GRID_HOURS = 48
STEP_HOURS = 4
RISE_PERCENT, RISE_ABSOLUTE, LOW_OUTPUT = 50, 0.3, 500


def of_items(events: DataFrame, items: list[int]) -> DataFrame:
    return events.where(F.col("itemid").isin(items))


def timeline(patients: DataFrame, admissions: DataFrame, icustays: DataFrame) -> DataFrame:
    """One row per stay of a plausible adult, with demographics and admission data."""
    joined = (
        patients.select("subject_id", "gender", "dob")
        .join(
            admissions.select("subject_id", "hadm_id", "admittime", "dischtime", "hospital_expire_flag"),
            "subject_id",
        )
        .join(
            icustays.select("subject_id", "hadm_id", "icustay_id", "intime", "outtime", "los"),
            ["subject_id", "hadm_id"],
        )
        .dropna(subset=["dob", "admittime"])
    )
    return joined.withColumn("age", completed_years("admittime", "dob")).where(
        plausible_adult("dob", "admittime", "age")
    )


def measure_changes(stays: DataFrame, measures: DataFrame) -> DataFrame:
    """First and largest value during the stay, their difference, and the number of rows.

    The first row in time counts even when its value is missing.
    """
    spans = stays.select("icustay_id", "subject_id", "intime", "outtime")
    inside = interval_join(spans, measures, "subject_id", "intime", "outtime", "charttime")
    return (
        inside.groupBy("icustay_id", "subject_id")
        .agg(
            F.min_by("valuenum", F.struct("charttime", "row_id")).alias("baseline"),
            F.max("valuenum").alias("peak"),
            F.count(F.lit(1)).alias("num_measurements"),
        )
        .select(
            "icustay_id",
            "subject_id",
            "baseline",
            "peak",
            rise_percent("peak", "baseline").alias("pct_increase"),
            (F.col("peak") - F.col("baseline")).alias("abs_increase"),
            "num_measurements",
        )
    )


def output_totals(stays: DataFrame, outputs: DataFrame) -> DataFrame:
    """Total output during the stay and its 24-hour rate."""
    spans = stays.select("icustay_id", "subject_id", "intime", "outtime")
    inside = interval_join(spans, outputs, "subject_id", "intime", "outtime", "charttime")
    return (
        inside.groupBy("icustay_id", "subject_id", "intime", "outtime")
        .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_output"))
        .select(
            "icustay_id",
            "subject_id",
            "total_output",
            per_day("total_output", hours_between("outtime", "intime")).alias("output_per_24h"),
        )
    )


def label_stays(changes: DataFrame, totals: DataFrame) -> DataFrame:
    """Rule label over both feature tables; a missing figure never triggers the rule."""
    positive = (
        holds(F.col("pct_increase") >= RISE_PERCENT)
        | holds(F.col("abs_increase") >= RISE_ABSOLUTE)
        | holds(F.col("output_per_24h") < LOW_OUTPUT)
    )
    return changes.join(totals, ["icustay_id", "subject_id"], "full").withColumn(
        "label", positive.cast("int")
    )


def prevalence(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("stays"), (F.avg("label") * 100).alias("prevalence_percent")
    )


MODEL_COLUMNS = [
    "age",
    "gender_f",
    "los",
    "baseline",
    "peak",
    "pct_increase",
    "abs_increase",
    "num_measurements",
    "total_output",
    "output_per_24h",
    "hospital_expire_flag",
]


def model_frame(stay_timeline: DataFrame, labelled: DataFrame) -> DataFrame:
    """Feature table, one row per labelled stay; missing features are left for imputation."""
    return (
        stay_timeline.join(labelled, ["icustay_id", "subject_id"])
        .withColumn("gender_f", (F.col("gender") == "F").cast("int"))
        .select("icustay_id", *MODEL_COLUMNS, "label")
    )


# ---- regular grid -----------------------------------------------------------


def time_grid(
    stays: DataFrame, hours: int = GRID_HOURS, step: int = STEP_HOURS, *extra: str
) -> DataFrame:
    """One row per stay and step start."""
    return stays.select(
        "icustay_id", *extra, F.explode(F.sequence(F.lit(0), F.lit(hours // step - 1))).alias("step")
    ).withColumn("hours_since_start", F.col("step") * step)


def _early(stays: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    spans = stays.select("icustay_id", "subject_id", "intime").withColumn(
        "horizon", add_hours("intime", hours)
    )
    inside = interval_join(spans, events, "subject_id", "intime", "horizon", "charttime")
    return inside.withColumn("_h", hours_between("charttime", "intime"))


def grid_means(
    stays: DataFrame, measures: DataFrame, hours: int = GRID_HOURS, step: int = STEP_HOURS
) -> DataFrame:
    """Mean value in the window of half a step before to half a step after each step start.

    The windows tile the time line, so the step is arithmetic and no join to the grid is needed.
    """
    return _stepped_means(stays, measures, hours, step).where(F.col("step") < hours // step).drop("n")


def _stepped_means(stays, measures, hours, step) -> DataFrame:
    number = F.floor((F.col("_h") + step / 2) / step).cast("int")
    return (
        _early(stays, measures, hours)
        .groupBy("icustay_id", number.alias("step"))
        .agg(F.avg("valuenum").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    )


def grid_sums(
    stays: DataFrame, outputs: DataFrame, hours: int = GRID_HOURS, step: int = STEP_HOURS
) -> DataFrame:
    """Sum of outputs from each step start up to the next."""
    number = F.floor(F.col("_h") / step).cast("int")
    return (
        _early(stays, outputs, hours)
        .withColumn("step", number)
        .where(F.col("step") < hours // step)
        .groupBy("icustay_id", "step")
        .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum_output"))
    )


def sequences(
    stays: DataFrame,
    measures: DataFrame,
    outputs: DataFrame,
    labelled: DataFrame,
    hours: int = GRID_HOURS,
    step: int = STEP_HOURS,
    at_least: int = 2,
) -> DataFrame:
    """Filled grid of labelled stays with enough measurements; stays with gaps left are dropped.

    Grid, means and sums are stacked and folded by (stay, step), so each input is joined to the
    stays once; windows then run over the few rows of one stay.
    """
    grid = time_grid(
        stays.join(labelled.select("icustay_id", "label"), "icustay_id"), hours, step, "label"
    )
    steps = (
        grid.drop("hours_since_start")
        .unionByName(_stepped_means(stays, measures, hours, step), allowMissingColumns=True)
        .unionByName(grid_sums(stays, outputs, hours, step), allowMissingColumns=True)
        .groupBy("icustay_id", "step")
        .agg(
            F.max("label").alias("label"),
            F.max(F.when(F.col("step") < hours // step, F.col("mean_value"))).alias("mean_value"),
            F.max("sum_output").alias("sum_output"),
            F.sum("n").alias("n"),
        )
    )
    counted = steps.withColumn("n", F.sum("n").over(Window.partitionBy("icustay_id")))
    filled = fill_both_ways(counted, "icustay_id", "step", ["mean_value", "sum_output"])
    return filled.where(
        F.col("label").isNotNull()
        & (F.col("n") >= at_least)
        & F.col("mean_value").isNotNull()
        & F.col("sum_output").isNotNull()
    ).select(
        "icustay_id",
        "step",
        "mean_value",
        "sum_output",
        (F.col("step") * step).cast("double").alias("hours_since_start"),
        "label",
    )


SEQUENCE_FEATURES = ["mean_value", "sum_output", "hours_since_start"]


def scaled_sequences(seq: DataFrame) -> DataFrame:
    """Features scaled over all stays and steps; the grid is read twice, so it is written out once."""
    return scale_min_max(cut_lineage(seq), SEQUENCE_FEATURES)


def sequence_summary(seq: DataFrame) -> DataFrame:
    """Shape of the sequence set, class counts and the share of positives."""
    per_stay = seq.groupBy("icustay_id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("steps"))
    return per_stay.agg(
        F.count(F.lit(1)).alias("stays"),
        F.max("steps").alias("steps"),
        F.lit(len(SEQUENCE_FEATURES)).cast("bigint").alias("features"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label") == 1).alias("positives"),
        (F.avg("label") * 100).alias("positive_percent"),
    )


def cap_subjects(df: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """All rows of at most ``limit`` subjects, chosen by a repeatable hash order."""
    chosen = (
        df.select("subject_id").distinct().orderBy(mixed("subject_id", seed), "subject_id").limit(limit)
    )
    return df.join(chosen, "subject_id", "left_semi")
