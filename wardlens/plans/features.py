"""Splits, shuffles and the multimodal admission table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import completed_years, hours_between, mentions_word, MIXED_END, mixed
from wardlens.operators.ordered import smallest_share
from wardlens.operators.shape import most_frequent_values, pivot_means


def split_rows(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark about ``share`` of the rows as test rows; a row's side depends on its key alone."""
    return df.withColumn("is_test", mixed(key, seed) < F.lit(int(share * MIXED_END)))


def split_stratified(
    df: DataFrame, key: str, by: str, share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Mark ``floor(share * n)`` rows of every class as test rows."""
    return smallest_share(df, mixed(key, seed), share, [by], tie=key, flag="is_test")


def split_positional(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of the rows in key order as training rows."""
    return smallest_share(df, F.col(key), share, flag="is_train")


def shuffled(df: DataFrame, key: str | Column, seed: int = 42, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows in a seeded random order that depends on their key only; (key, ties) tell rows apart.

    One range exchange, no global numbering.
    """
    value = F.col(key) if isinstance(key, str) else key
    return df.withColumn("shuffle_key", mixed(value, seed)).orderBy("shuffle_key", value, *ties)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias("weight")
    )


def gender_dummies(df: DataFrame, column: str = "gender", levels: tuple[str, ...] = ("F", "M")) -> DataFrame:
    return df.select(
        "*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in levels]
    ).drop(column)


def earliest_notes(notes: DataFrame, admissions: DataFrame | None = None) -> DataFrame:
    """First non-missing value per column and admission, in time order; of the given admissions only, if any.

    Text and time may come from different notes: a column skips the notes where it is missing. The note is
    chosen on narrow columns, and its text is fetched by ``row_id`` (a key of the notes) afterwards, so no
    aggregate, sort or window holds a text.
    """
    timed = notes.where(F.col("hadm_id").isNotNull()).select(
        "hadm_id", "charttime", "row_id", F.col("text").isNotNull().alias("_has_text")
    )
    if admissions is not None:
        timed = timed.join(admissions, "hadm_id", "left_semi")
    first = F.struct(F.col("charttime").isNull(), F.col("charttime"), F.col("row_id").alias("row_id"))
    chosen = timed.groupBy("hadm_id").agg(
        F.min(F.when(F.col("_has_text"), first)).alias("_first"), F.min("charttime").alias("charttime")
    )
    chosen = chosen.select("hadm_id", "charttime", F.col("_first.row_id").alias("row_id"))
    texts = notes.where(F.col("text").isNotNull()).select("row_id", "text")
    return chosen.join(texts, "row_id", "left").select("hadm_id", "text", "charttime")


def multimodal(
    admissions: DataFrame,
    patients: DataFrame,
    labevents: DataFrame,
    notes: DataFrame,
    word: str = "sepsis",
    items: int = 20,
) -> DataFrame:
    """Admissions whose diagnosis names the word, with age, gender, mean labs and first note.

    Readings and notes are cut down to the cohort before they are aggregated; the commonest items are those of
    all readings.
    """
    chosen = admissions.where(mentions_word("diagnosis", word) & F.col("hospital_expire_flag").isNotNull())
    cohort = (
        chosen.select("hadm_id", "subject_id", "admittime", "hospital_expire_flag")
        .join(patients.select("subject_id", "gender", "dob"), "subject_id", "left")
        .withColumn("age", completed_years("admittime", "dob"))
    )
    ids = chosen.select("hadm_id")
    top = sorted(most_frequent_values(labevents, "itemid", items))
    readings = labevents.where(F.col("itemid").isin(top)).join(ids, "hadm_id", "left_semi")
    labs = pivot_means(readings, "hadm_id", "itemid", "valuenum", top, prefix="lab_")
    return (
        cohort.join(labs, "hadm_id", "left")
        .join(earliest_notes(notes, ids).where(F.col("text").isNotNull()), "hadm_id")
        .withColumn("hours_from_admission", hours_between("charttime", "admittime"))
        .drop("dob")
    )


def lab_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("lab_")]
