"""Cohort reports over admissions, diagnoses and the tables around them.

A cohort is given by a diagnosis code prefix, either as primary diagnosis (position 1) or at any
position. Before a join the cohort side is reduced to one row per key, so a join never multiplies a
hot key by itself: the large side passes through once and keeps its row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import (
    age_decade,
    age_decade_label,
    creatinine_band,
    days_between,
    first_digits,
    has_prefix,
    lacks_prefix,
    percent,
    percent_up,
    year_boundaries,
    yes_no,
)
from wardlens.operators.ordered import next_in_time, over_all
from wardlens.sources.writers import save_table

PREFIX = "584"


def matching(diagnoses: DataFrame, prefix: str = PREFIX, primary: bool = False) -> DataFrame:
    hit = has_prefix("icd9_code", prefix)
    return diagnoses.where(hit & (F.col("seq_num") == 1) if primary else hit)


def matches_per(diagnoses: DataFrame, key: str, prefix: str = PREFIX, primary: bool = False) -> DataFrame:
    """Matching diagnosis rows per key: the fan-out a row join would have, as a count."""
    return matching(diagnoses, prefix, primary).groupBy(key).agg(F.count(F.lit(1)).alias("n_match"))


def cohort_admission_ids(diagnoses: DataFrame, prefix: str = PREFIX, primary: bool = False) -> DataFrame:
    return matching(diagnoses, prefix, primary).select("hadm_id").distinct()


def cohort_subject_ids(diagnoses: DataFrame, admissions: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return (
        admissions.join(cohort_admission_ids(diagnoses, prefix), "hadm_id", "left_semi")
        .select("subject_id")
        .distinct()
    )


# ---- diagnoses --------------------------------------------------------------


def cases_by_code(diagnoses: DataFrame, dictionary: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return (
        matches_per(diagnoses, "icd9_code", prefix, primary=True)
        .join(dictionary, "icd9_code")
        .groupBy("icd9_code", "short_title", "long_title")
        .agg(F.sum("n_match").alias("total_cases"))
        .orderBy(F.desc("total_cases"), "icd9_code")
    )


def _index_by_admission(diagnoses, dictionary, prefix, *extra) -> DataFrame:
    """Primary matches known to the dictionary: one row per admission (and title)."""
    return (
        matching(diagnoses, prefix, primary=True)
        .join(dictionary, "icd9_code")
        .groupBy("subject_id", "hadm_id", *extra)
        .agg(F.count(F.lit(1)).alias("n_index"))
    )


def comorbidities(
    diagnoses: DataFrame,
    dictionary: DataFrame,
    prefix: str = PREFIX,
    position: int | None = None,
    more_than: int | None = None,
) -> DataFrame:
    """Other diagnoses of the same admission, counted once per index row."""
    other = diagnoses.where(lacks_prefix("icd9_code", prefix))
    if position is not None:
        other = other.where(F.col("seq_num") == position)
    counted = (
        other.select("subject_id", "hadm_id", "icd9_code")
        .join(_index_by_admission(diagnoses, dictionary, prefix), ["subject_id", "hadm_id"])
        .groupBy("icd9_code")
        .agg(F.sum("n_index").alias("n"))
        .join(dictionary, "icd9_code")
        .groupBy("short_title", "icd9_code")
        .agg(F.sum("n").alias("comorbidity_count"))
    )
    if more_than is not None:
        counted = counted.where(F.col("comorbidity_count") > more_than)
    return counted.select("short_title", "comorbidity_count").orderBy(
        F.desc("comorbidity_count"), "short_title"
    )


def comorbidities_by_index(
    diagnoses: DataFrame, dictionary: DataFrame, prefix: str = PREFIX, more_than: int = 10
) -> DataFrame:
    """As :func:`comorbidities`, keyed by the index diagnosis title as well."""
    index = _index_by_admission(diagnoses, dictionary, prefix, "short_title")
    other = (
        diagnoses.where(lacks_prefix("icd9_code", prefix))
        .join(index.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")
        .groupBy("subject_id", "hadm_id", "icd9_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        other.join(
            index.withColumnRenamed("short_title", "index_diagnosis"), ["subject_id", "hadm_id"]
        )
        .groupBy("index_diagnosis", "icd9_code")
        .agg(F.sum(F.col("n") * F.col("n_index")).alias("n"))
        .join(dictionary, "icd9_code")
        .groupBy("index_diagnosis", "short_title", "icd9_code")
        .agg(F.sum("n").alias("comorbidity_count"))
        .where(F.col("comorbidity_count") > more_than)
        .select("index_diagnosis", F.col("short_title").alias("comorbidity_diagnosis"), "comorbidity_count")
        .orderBy("index_diagnosis", F.desc("comorbidity_count"), "comorbidity_diagnosis")
    )


def share_by_ethnicity(
    diagnoses: DataFrame,
    admissions: DataFrame,
    prefix: str = PREFIX,
    more_than: int = 500,
    dedup: bool = False,
) -> DataFrame:
    """Case share per group. The link is the subject, so each admission of a case subject counts
    once per primary case row and a share can pass 100; ``dedup`` counts each admission once."""
    totals = (
        admissions.groupBy("ethnicity")
        .agg(F.count(F.lit(1)).alias("all_admissions"))
        .where(F.col("all_admissions") > more_than)
    )
    cases = matches_per(diagnoses, "subject_id", prefix, primary=True)
    if dedup:
        cases = cases.withColumn("n_match", F.lit(1).cast("bigint"))
    return (
        admissions.select("subject_id", "ethnicity")
        .join(cases, "subject_id")
        .groupBy("ethnicity")
        .agg(F.sum("n_match").alias("cases"))
        .join(totals, "ethnicity")
        .select(
            "ethnicity",
            "cases",
            "all_admissions",
            percent_up(F.col("cases"), F.col("all_admissions")).alias("percentage"),
        )
        .orderBy(F.desc("percentage"), "ethnicity")
    )


# ---- readmission ------------------------------------------------------------

READMISSION_LIMITS = (60, 30, 7)


def readmissions(
    diagnoses: DataFrame, admissions: DataFrame, prefix: str = PREFIX, ordered: bool = True
) -> DataFrame:
    """Per cohort admission: the subject's next cohort admission and flags for 60, 30 and 7 days.

    No next admission gives NO, a next admission before discharge gives YES.
    """
    cohort = (
        admissions.select("subject_id", "hadm_id", "admittime", "dischtime")
        .join(cohort_admission_ids(diagnoses, prefix), "hadm_id", "left_semi")
        .distinct()
    )
    following = next_in_time(cohort, ["subject_id"], "admittime", "hadm_id", "next_admittime")
    gap = days_between("next_admittime", "dischtime")
    out = following.select(
        "subject_id",
        "hadm_id",
        "admittime",
        "dischtime",
        "next_admittime",
        gap.alias("days_until_next"),
        *[yes_no(gap <= d).alias(f"readmitted_within_{d}_days") for d in READMISSION_LIMITS],
    )
    return out.orderBy("subject_id", "admittime", "hadm_id") if ordered else out


def store_readmissions(
    diagnoses: DataFrame, admissions: DataFrame, name: str, prefix: str = PREFIX, buckets: int | None = None, path: str | None = None
) -> DataFrame:
    """:func:`readmissions` as a catalog table, created or replaced, in buckets by subject.

    Rates and joins by subject read it from then on, so the cohort is built once. There are as many buckets as
    shuffle partitions unless told otherwise.
    """
    table = readmissions(diagnoses, admissions, prefix, ordered=False)
    buckets = buckets or int(diagnoses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save_table(table, name, bucket_by=["subject_id"], buckets=buckets, path=path)


def readmission_rates(table: DataFrame, limits: tuple[int, ...] = READMISSION_LIMITS) -> DataFrame:
    """:func:`readmission_rate` for several limits from one scan, as (days, total_admissions, ...)."""
    hits = [F.count_if(F.col(f"readmitted_within_{d}_days") == "YES").alias(f"h{d}") for d in limits]
    counted = table.agg(F.count(F.lit(1)).alias("total_admissions"), *hits)
    each = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"h{d}").alias("readmissions")) for d in limits])
    return counted.select("total_admissions", F.inline(each)).select(
        "days", "total_admissions", "readmissions", percent_up(F.col("readmissions"), F.col("total_admissions")).alias("readmission_rate_percent")
    )


def subject_readmissions(table: DataFrame) -> DataFrame:
    """Cohort admissions and readmissions within 30 days per subject; a table in buckets by subject is not shuffled."""
    return table.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("admissions"), F.count_if(F.col("readmitted_within_30_days") == "YES").alias("readmitted")
    )


def readmission_rate(table: DataFrame, days: int) -> DataFrame:
    hits = F.count_if(F.col(f"readmitted_within_{days}_days") == "YES")
    return table.agg(
        F.count(F.lit(1)).alias("total_admissions"),
        hits.alias("readmissions"),
        percent_up(hits, F.count(F.lit(1))).alias("readmission_rate_percent"),
    )


def readmission_by_stay_length(table: DataFrame, days: int = 30) -> DataFrame:
    hits = F.count_if(F.col(f"readmitted_within_{days}_days") == "YES")
    return (
        table.groupBy(days_between("dischtime", "admittime").alias("length_of_stay"))
        .agg(
            F.count(F.lit(1)).alias("total_admissions"),
            hits.alias("readmissions"),
            percent_up(hits, F.count(F.lit(1))).alias("readmission_rate_percent"),
        )
        .orderBy(F.desc("length_of_stay"))
    )


# ---- drugs, labs, procedures ------------------------------------------------


def drugs_by_admissions(diagnoses: DataFrame, prescriptions: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return (
        prescriptions.select("hadm_id", "drug")
        .join(cohort_admission_ids(diagnoses, prefix), "hadm_id", "left_semi")
        .groupBy("drug")
        .agg(F.count_distinct("hadm_id").alias("prescriptions_count"))
        .orderBy(F.desc("prescriptions_count"), "drug")
    )


def drug_doses(
    diagnoses: DataFrame,
    admissions: DataFrame,
    prescriptions: DataFrame,
    prefix: str = PREFIX,
    top: int = 10,
) -> DataFrame:
    """Top drugs of cohort subjects with the mean of the first number in the dose text."""
    return (
        prescriptions.where(F.col("dose_val_rx").isNotNull())
        .select("subject_id", "drug", first_digits("dose_val_rx").alias("dose"))
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .groupBy("drug")
        .agg(F.avg("dose").alias("avg_dose"), F.count(F.lit(1)).alias("prescription_count"))
        .orderBy(F.desc("prescription_count"), "drug")
        .limit(top)
    )


def abnormal_labs(
    diagnoses: DataFrame,
    admissions: DataFrame,
    labevents: DataFrame,
    labitems: DataFrame,
    prefix: str = PREFIX,
    top: int = 10,
) -> DataFrame:
    return (
        labevents.where(F.col("flag") == "abnormal")
        .select("subject_id", "itemid")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .groupBy("itemid")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(labitems, "itemid")
        .groupBy("itemid", "label")
        .agg(F.sum("n").alias("abnormal_count"))
        .orderBy(F.desc("abnormal_count"), "itemid")
        .limit(top)
    )


def procedures_top(
    diagnoses: DataFrame,
    admissions: DataFrame,
    procedures: DataFrame,
    dictionary: DataFrame,
    prefix: str = PREFIX,
    top: int = 10,
) -> DataFrame:
    return (
        procedures.select("subject_id", "icd9_code")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .groupBy("icd9_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(dictionary, "icd9_code")
        .groupBy("icd9_code", "short_title")
        .agg(F.sum("n").alias("procedure_count"))
        .orderBy(F.desc("procedure_count"), "icd9_code")
        .limit(top)
    )


# ---- demographics, outcome --------------------------------------------------


def cases_by_age_gender(
    diagnoses: DataFrame, admissions: DataFrame, patients: DataFrame, prefix: str = PREFIX
) -> DataFrame:
    return (
        admissions.select("hadm_id", "subject_id", "admittime")
        .join(matches_per(diagnoses, "hadm_id", prefix, primary=True), "hadm_id")
        .join(patients.select("subject_id", "gender", "dob"), "subject_id")
        .groupBy("gender", age_decade(year_boundaries("admittime", "dob")).alias("age_group"))
        .agg(F.sum("n_match").alias("admissions"))
        .orderBy("gender", "age_group")
    )


def mortality_by_stay_length(
    diagnoses: DataFrame, admissions: DataFrame, prefix: str = PREFIX, dedup: bool = False
) -> DataFrame:
    """One count per matching diagnosis row, or one per admission with ``dedup``."""
    weight = F.lit(1).cast("bigint") if dedup else F.col("n_match")
    return (
        admissions.join(matches_per(diagnoses, "hadm_id", prefix), "hadm_id")
        .groupBy(days_between("dischtime", "admittime").alias("length_of_stay"))
        .agg(
            F.sum(weight).alias("total_admissions"),
            F.sum(weight * F.col("hospital_expire_flag")).alias("mortality_count"),
        )
        .withColumn(
            "mortality_rate_percent", percent_up(F.col("mortality_count"), F.col("total_admissions"))
        )
        .orderBy("length_of_stay")
    )


def patients_by_unit(
    diagnoses: DataFrame, admissions: DataFrame, icustays: DataFrame, prefix: str = PREFIX
) -> DataFrame:
    return (
        icustays.select("subject_id", "first_careunit")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .groupBy("first_careunit")
        .agg(F.count_distinct("subject_id").alias("patient_count"))
        .orderBy(F.desc("patient_count"), "first_careunit")
    )


def cases_by_year(diagnoses: DataFrame, admissions: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return (
        admissions.select("hadm_id", "admittime")
        .join(matches_per(diagnoses, "hadm_id", prefix), "hadm_id")
        .groupBy(F.year("admittime").alias("admission_year"))
        .agg(F.sum("n_match").alias("admission_count"))
        .orderBy("admission_year")
    )


def mortality_by_unit(
    diagnoses: DataFrame,
    admissions: DataFrame,
    icustays: DataFrame,
    prefix: str = PREFIX,
    dedup: bool = False,
) -> DataFrame:
    """Deaths count ICU stay rows, patients are distinct, so a rate can pass 100; ``dedup`` counts
    distinct deceased patients instead."""
    died = F.col("hospital_expire_flag") == 1
    deceased = (
        F.count_distinct(F.when(died, F.col("subject_id"))) if dedup else F.count_if(died)
    )
    return (
        admissions.select("hadm_id", "subject_id", "hospital_expire_flag")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .join(icustays.select("hadm_id", "first_careunit"), "hadm_id")
        .groupBy("first_careunit")
        .agg(F.count_distinct("subject_id").alias("total_patients"), deceased.alias("deceased_count"))
        .withColumn("mortality_rate", percent(F.col("deceased_count"), F.col("total_patients")))
        .orderBy(F.desc("mortality_rate"), "first_careunit")
    )


def icu_stay_by_age_gender(
    diagnoses: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    icustays: DataFrame,
    prefix: str = PREFIX,
) -> DataFrame:
    grouped = (
        icustays.select("subject_id", "intime", "los")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .join(patients.select("subject_id", "gender", "dob"), "subject_id")
        .groupBy("gender", age_decade_label(year_boundaries("intime", "dob")).alias("age_group"))
        .agg(F.count(F.lit(1)).alias("patient_count"), F.round(F.avg("los"), 2).alias("avg_icu_los_days"))
    )
    total = over_all(F.sum("patient_count"))
    return grouped.withColumn(
        "proportion_percent", percent(F.col("patient_count"), total)
    ).orderBy("gender", "age_group")


def discharge_locations(diagnoses: DataFrame, admissions: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return (
        admissions.select("subject_id", "discharge_location")
        .join(cohort_subject_ids(diagnoses, admissions, prefix), "subject_id", "left_semi")
        .groupBy("discharge_location")
        .agg(F.count(F.lit(1)).alias("discharge_count"))
        .orderBy(F.desc("discharge_count"), "discharge_location")
    )


def mortality_by_creatinine(
    diagnoses: DataFrame,
    admissions: DataFrame,
    labevents: DataFrame,
    labitems: DataFrame,
    prefix: str = PREFIX,
    label: str = "Creatinine",
    dedup: bool = False,
) -> DataFrame:
    """Bands of the peak value per subject; rows are matching diagnoses (admissions if ``dedup``)."""
    weight = F.lit(1).cast("bigint") if dedup else F.col("n_match")
    per_subject = (
        admissions.select("hadm_id", "subject_id", "hospital_expire_flag")
        .join(matches_per(diagnoses, "hadm_id", prefix), "hadm_id")
        .groupBy("subject_id")
        .agg(F.sum(weight).alias("n"), F.sum(weight * F.col("hospital_expire_flag")).alias("died"))
    )
    peaks = (
        labevents.join(labitems.where(F.col("label") == label), "itemid", "left_semi")
        .join(per_subject, "subject_id", "left_semi")
        .groupBy("subject_id")
        .agg(F.max(F.col("valuenum").cast("double")).alias("peak"))
    )
    return (
        per_subject.join(peaks, "subject_id")
        .groupBy(creatinine_band("peak").alias("creatinine_level"))
        .agg(F.sum("n").alias("patient_count"), F.sum("died").alias("deceased_count"))
        .withColumn("mortality_rate", percent(F.col("deceased_count"), F.col("patient_count")))
        .orderBy(F.desc("mortality_rate"), "creatinine_level")
    )
