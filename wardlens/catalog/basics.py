"""Sources, sinks and the single operators the reports are made of (SRC, SNK, FLT, PRJ, JN, AG, WN, ST, SE, FN, UD)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.catalog.cohort import COHORT, READMITTED
from wardlens.functions import scalars as sc
from wardlens.operators import joins, ordered, shape
from wardlens.plans import cohort as c
from wardlens.plans import features as f
from wardlens.plans import models as m
from wardlens.session import scratch_path
from wardlens.sources import readers, writers

# ---- sources and sinks ------------------------------------------------------


@query("src01_snk02_csv_round_trip", "SELECT row_id, hadm_id, charttime, category, text FROM noteevents")
def _(t):
    path = scratch_path(t.spark, "notes")
    notes = t.noteevents.select("row_id", "hadm_id", "charttime", "category", "text")
    writers.save_csv(notes, path)
    return readers.read_csv(t.spark, path, notes.schema, multi_line=True)


@query("src02_read_table", "SELECT subject_id, gender, dob FROM patients")
def _(t):
    t.patients.createOrReplaceTempView("wardlens_patients")
    return readers.read_table(t.spark, "wardlens_patients")


@query(
    "src03_read_query",
    "SELECT o_orderkey AS hadm_id, o_orderpriority AS insurance FROM orders WHERE o_totalprice > 100000",
)
def _(t):
    return readers.read_query(
        t.spark,
        "SELECT o_orderkey AS hadm_id, o_orderpriority AS insurance FROM {orders} WHERE o_totalprice > 100000",
        orders=t.orders,
    )


DIAGNOSIS_FIELDS = ["row_id", "subject_id", "hadm_id", "seq_num", "icd9_code"]
RECORD = "concat_ws(',', hadm_id * 10 + seq_num, subject_id, hadm_id, seq_num, icd9_code)"
FIELDS = """SELECT CAST(hadm_id * 10 + seq_num AS VARCHAR) AS row_id, CAST(subject_id AS VARCHAR) AS subject_id,
       CAST(hadm_id AS VARCHAR) AS hadm_id, CAST(seq_num AS VARCHAR) AS seq_num, icd9_code FROM diagnoses"""


@query("src04_repair_csv", FIELDS)
def _(t):
    """Every record is written as one quoted cell, every third one broken into two cells."""
    path = scratch_path(t.spark, "broken")
    first = "concat_ws(',', hadm_id * 10 + seq_num, subject_id, hadm_id)"
    lines = t.diagnoses.select(
        F.when(F.col("seq_num") % 3 == 0, F.expr(f"""concat('"', {first}, '",",', seq_num, ',', icd9_code, '"')"""))
        .otherwise(F.expr(f"""concat('"', {RECORD}, '"')"""))
        .alias("value")
    )
    header = t.region.limit(1).select(F.lit(",".join(DIAGNOSIS_FIELDS)).alias("value"))
    header.unionByName(lines).write.text(path)
    return readers.repair_csv(t.spark, path, DIAGNOSIS_FIELDS)


@query("src05_rows_from_filenames", FIELDS)
def _(t):
    names = t.diagnoses.select(
        F.expr("concat('data/', '__', concat_ws('_', hadm_id * 10 + seq_num, subject_id, hadm_id, seq_num, icd9_code), '_')").alias("path")
    )
    return names.select(*readers.fields_of_name("path", DIAGNOSIS_FIELDS))


@query(
    "src06_quality_report",
    """SELECT 'admissions' AS table_name, count(*) AS n_rows, count(*) = 0 AS is_empty FROM admissions
       UNION ALL SELECT 'icustays', count(*), count(*) = 0 FROM icustays
       UNION ALL SELECT 'unlabelled', count(*), count(*) = 0 FROM labels WHERE quality > 5""",
)
def _(t):
    return readers.quality_report(
        {"admissions": t.admissions, "icustays": t.icustays, "unlabelled": t.labels.where("quality > 5")}
    )


@query(
    "cq07_snk01_readmission_table",
    f"""SELECT *, CASE WHEN days_until_next <= 60 THEN 'YES' ELSE 'NO' END AS readmitted_within_60_days,
               CASE WHEN days_until_next <= 30 THEN 'YES' ELSE 'NO' END AS readmitted_within_30_days,
               CASE WHEN days_until_next <= 7 THEN 'YES' ELSE 'NO' END AS readmitted_within_7_days
        FROM ({READMITTED})""",
)
def _(t):
    return _stored(t)


def _stored(t):
    """The cohort table in the session's catalog; its files lie in the shared folder."""
    return c.store_readmissions(t.diagnoses, t.admissions, "wardlens_readmissions", path=scratch_path(t.spark, "readmissions"))


@query(
    "cq07_rates_of_stored_table",
    " UNION ALL ".join(
        f"""SELECT {d} AS days, count(*) AS total_admissions, count(*) FILTER (WHERE days_until_next <= {d}) AS readmissions,
                   ceil(count(*) FILTER (WHERE days_until_next <= {d}) / nullif(count(*), 0)::DOUBLE * 100) AS readmission_rate_percent
            FROM ({READMITTED})"""
        for d in (60, 30, 7)
    ),
)
def _(t):
    return c.readmission_rates(_stored(t))


@query(
    "cq07_subjects_of_stored_table",
    f"""SELECT subject_id, count(*) AS admissions, count(*) FILTER (WHERE days_until_next <= 30) AS readmitted,
               max(gender) AS gender FROM ({READMITTED}) JOIN patients USING (subject_id) GROUP BY subject_id""",
)
def _(t):
    return c.subject_readmissions(_stored(t)).join(t.patients.select("subject_id", "gender"), "subject_id")


@query(
    "snk03_feature_matrix",
    "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings",
)
def _(t):
    matrix = t.embeddings.withColumn("features", array_to_vector("embedding")).drop("embedding")
    back = writers.save_parquet(matrix, scratch_path(t.spark, "matrix"))
    values = vector_to_array("features")
    return back.select("vec_id", "label", F.round(values[0], 6).alias("first"), F.round(values[63], 6).alias("last"))


@query("snk04_model_round_trip", "SELECT doc_id, 0.0::DOUBLE AS difference FROM documents JOIN labels USING (doc_id)")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    model = m.note_classifier(rows, dims=256, rounds=5)
    again = writers.save_model(model, scratch_path(t.spark, "model"))
    one = m.with_probability(model, rows, "p", keep=["doc_id"])
    two = m.with_probability(again, rows, "q", keep=["doc_id"])
    return one.join(two, "doc_id").select("doc_id", F.round(F.abs(F.col("p") - F.col("q")), 6).alias("difference"))


# ---- filters and projections ------------------------------------------------


@query(
    "flt01_prefixes",
    "SELECT * FROM diagnoses WHERE icd9_code LIKE '584%' OR icd9_code LIKE '586%'",
)
def _(t):
    return t.diagnoses.where(sc.has_prefix("icd9_code", "584", "586"))


@query("flt02_negated_prefix", "SELECT * FROM prescriptions WHERE dose_val_rx NOT LIKE '1%'")
def _(t):
    return t.prescriptions.where(sc.lacks_prefix("dose_val_rx", "1"))


@query(
    "flt03_ranges",
    "SELECT * FROM labevents WHERE valuenum BETWEEN 1.2 AND 2.0 AND hadm_id IS NOT NULL AND flag = 'abnormal'",
)
def _(t):
    return t.labevents.where(
        F.col("valuenum").between(1.2, 2.0) & F.col("hadm_id").isNotNull() & (F.col("flag") == "abnormal")
    )


@query("flt04_membership", f"SELECT * FROM labevents WHERE itemid IN (3, 12) AND hadm_id IN ({COHORT})")
def _(t):
    ids = c.cohort_admission_ids(t.diagnoses)
    return t.labevents.where(F.col("itemid").isin(3, 12)).join(ids, "hadm_id", "left_semi")


@query("flt05_word_in_text", r"SELECT * FROM admissions WHERE coalesce(regexp_matches(diagnosis, '(?i)\bsepsis\b'), FALSE)")
def _(t):
    return t.admissions.where(sc.mentions_word("diagnosis", "sepsis"))


@query("flt06_drop_missing", "SELECT * FROM noteevents WHERE text IS NOT NULL AND charttime IS NOT NULL")
def _(t):
    return t.noteevents.dropna(subset=["text", "charttime"])


AGE = """(year(admittime) - year(dob) - CASE WHEN (month(admittime), day(admittime)) < (month(dob), day(dob)) THEN 1 ELSE 0 END)::INT"""


@query(
    "flt07_plausible_adults",
    f"""SELECT hadm_id, age FROM (SELECT hadm_id, admittime, dob, {AGE} AS age FROM admissions JOIN patients USING (subject_id))
        WHERE year(dob) > 1800 AND year(admittime) > 2000 AND admittime > dob AND age BETWEEN 18 AND 100""",
)
def _(t):
    aged = t.admissions.join(t.patients, "subject_id").withColumn("age", sc.completed_years("admittime", "dob"))
    return aged.where(sc.plausible_adult("dob", "admittime", "age")).select("hadm_id", "age")


@query(
    "flt08_rule_label",
    """SELECT row_id, CASE WHEN coalesce(valuenum >= 50, FALSE) OR coalesce(valuenum / 0 < 1, FALSE) OR coalesce(valuenum < 5, FALSE)
                           THEN 1 ELSE 0 END AS label FROM measures""",
)
def _(t):
    v = F.col("valuenum")
    rule = sc.holds(v >= 50) | sc.holds(F.try_divide(v, F.lit(0)) < 1) | sc.holds(v < 5)
    return t.measures.select("row_id", rule.cast("int").alias("label"))


@query(
    "flt09_having",
    "SELECT icd9_code, count(*) AS n FROM diagnoses GROUP BY 1 HAVING count(*) > 300",
)
def _(t):
    return t.diagnoses.groupBy("icd9_code").agg(F.count(F.lit(1)).alias("n")).where("n > 300")


@query(
    "flt11_trimmed_prices",
    """WITH a AS (SELECT * FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)
                                                             AND (SELECT quantile_cont(o_totalprice, 0.99) FROM orders))
       SELECT * FROM a WHERE o_custkey BETWEEN (SELECT quantile_cont(o_custkey, 0.01) FROM a) AND (SELECT quantile_cont(o_custkey, 0.99) FROM a)""",
)
def _(t):
    return shape.trim_outliers(t.orders, ["o_totalprice", "o_custkey"])


@query("prj02_creatinine_band", """SELECT itemid, CASE WHEN valuenum < 1.2 THEN 'Normal' WHEN valuenum BETWEEN 1.2 AND 2.0 THEN 'Mildly Elevated'
       ELSE 'Severely Elevated' END AS band, count(*) AS n FROM labevents GROUP BY 1, 2""")
def _(t):
    return t.labevents.groupBy("itemid", sc.creatinine_band("valuenum").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj03_yes_no_and_weekend",
    """SELECT event_id, CASE WHEN value > 50 THEN 'YES' ELSE 'NO' END AS high,
              CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_kind FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", sc.yes_no(F.col("value") > 50).alias("high"), sc.weekend_label("ts").alias("day_kind")
    )


@query(
    "prj05_age_bins",
    """SELECT subject_id, CASE WHEN k <= 0 THEN NULL WHEN k <= 18 THEN '0-18' WHEN k <= 40 THEN '19-40' WHEN k <= 65 THEN '41-65'
              WHEN k <= 90 THEN '66-90' WHEN k <= 120 THEN '90+' END AS age_group
       FROM (SELECT subject_id, subject_id % 100 AS k FROM patients)""",
)
def _(t):
    return t.patients.select("subject_id", sc.age_bin(F.col("subject_id") % 100).alias("age_group"))


@query(
    "prj06_risk_buckets",
    """SELECT case_id, CASE WHEN p_forest < 0.2::DOUBLE THEN 'Very Low' WHEN p_forest < 0.4::DOUBLE THEN 'Low'
              WHEN p_forest < 0.6::DOUBLE THEN 'Moderate' WHEN p_forest < 0.8::DOUBLE THEN 'High'
              WHEN p_forest < 1.0::DOUBLE THEN 'Very High' END AS risk FROM scored""",
)
def _(t):
    return t.scored.select("case_id", sc.risk_bucket("p_forest").alias("risk"))


@query(
    "prj07_gender_dummies",
    "SELECT subject_id, (gender = 'F')::INT AS gender_F, (gender = 'M')::INT AS gender_M FROM patients",
)
def _(t):
    return f.gender_dummies(t.patients.select("subject_id", "gender"))


# ---- joins ------------------------------------------------------------------


@query(
    "jn01_inner_join",
    "SELECT l.subject_id, label, valuenum FROM labevents l JOIN d_labitems i ON l.itemid = i.itemid WHERE label = 'Creatinine'",
)
def _(t):
    return (
        t.labevents.join(t.d_labitems, "itemid").where("label = 'Creatinine'").select("subject_id", "label", "valuenum")
    )


@query(
    "jn04_left_join",
    "SELECT a.hadm_id, i.icustay_id, los FROM admissions a LEFT JOIN icustays i ON a.hadm_id = i.hadm_id",
)
def _(t):
    return t.admissions.select("hadm_id").join(t.icustays, "hadm_id", "left").select("hadm_id", "icustay_id", "los")


@query(
    "jn05_full_join",
    """SELECT coalesce(a.k, b.k) AS k, n_a, n_b FROM (SELECT c_nationkey AS k, count(*) AS n_a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_b FROM supplier GROUP BY 1) b ON a.k = b.k""",
)
def _(t):
    one = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_a"))
    two = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_b"))
    return one.join(two, "k", "full")


@query(
    "jn06_interval_join",
    """SELECT s.icustay_id, m.row_id FROM stays s JOIN measures m ON s.subject_id = m.subject_id
         AND charttime >= intime AND charttime <= outtime""",
)
def _(t):
    spans = t.stays.select("icustay_id", "subject_id", "intime", "outtime")
    return joins.interval_join(spans, t.measures, "subject_id", "intime", "outtime", "charttime").select("icustay_id", "row_id")


@query(
    "jn09_group_total",
    "SELECT hadm_id, count(*) OVER (PARTITION BY subject_id) AS admissions_of_subject FROM admissions",
)
def _(t):
    totals = t.admissions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("admissions_of_subject"))
    return t.admissions.join(totals, "subject_id").select("hadm_id", "admissions_of_subject")


@query(
    "jn10_lookup_with_default",
    "SELECT p_partkey, coalesce(weight, 0) AS weight FROM part LEFT JOIN severities ON symptom = p_brand",
)
def _(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("symptom"))
    return joins.lookup(rows, t.severities, "symptom", "weight", 0).select("p_partkey", "weight")


# ---- aggregates -------------------------------------------------------------


@query(
    "ag05_first_value",
    """SELECT subject_id, arg_min_null(valuenum, row(charttime, row_id)) AS first_value,
              max(valuenum) AS top, count(*) AS n FROM measures GROUP BY 1""",
)
def _(t):
    return t.measures.groupBy("subject_id").agg(
        F.min_by("valuenum", F.struct("charttime", "row_id")).alias("first_value"),
        F.max("valuenum").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "ag07_exact_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(median(l_extendedprice), 6) AS p50,
              round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def _(t):
    out = ordered.exact_percentiles(
        t.lineitem, "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, ["l_returnflag"]
    )
    return out.select("l_returnflag", *[F.round(p, 6).alias(p) for p in ("p01", "p50", "p99")])


@query(
    "ag07_exact_percentiles_many_groups",
    """SELECT l_partkey, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_quantity), 6) AS q2 FROM lineitem GROUP BY 1""",
)
def _(t):
    out = ordered.exact_percentiles(t.lineitem, "l_quantity", {"q1": 0.25, "q2": 0.5}, ["l_partkey"])
    return out.select("l_partkey", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("q2"))


@query("ag10_most_frequent", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(t):
    return shape.most_frequent(t.part, "p_type", 3)


@query(
    "ag11_pivot_counts",
    """SELECT hour(intime)::INT AS hour, """
    + ", ".join(f"count(*) FILTER (WHERE first_careunit = 'UNIT_{i}') AS \"UNIT_{i}\"" for i in range(6))
    + " FROM icustays GROUP BY 1",
)
def _(t):
    rows = t.icustays.select(F.hour("intime").alias("hour"), "first_careunit")
    return shape.pivot_counts(rows, "hour", "first_careunit", [f"UNIT_{i}" for i in range(6)])


@query(
    "ag12_pivot_means",
    """SELECT hadm_id, round(avg(valuenum) FILTER (WHERE itemid = 3), 6) AS lab_3, round(avg(valuenum) FILTER (WHERE itemid = 12), 6) AS lab_12
       FROM labevents WHERE hadm_id IS NOT NULL GROUP BY 1""",
)
def _(t):
    out = shape.pivot_means(t.labevents, "hadm_id", "itemid", "valuenum", [3, 12], "lab_")
    return out.select("hadm_id", F.round("lab_3", 6).alias("lab_3"), F.round("lab_12", 6).alias("lab_12"))


@query(
    "ag14_first_present",
    """SELECT hadm_id, arg_min(text, row(charttime IS NULL, charttime, row_id)) FILTER (WHERE text IS NOT NULL) AS text,
              min(charttime) AS charttime FROM noteevents GROUP BY 1""",
)
def _(t):
    return f.earliest_notes(t.noteevents)


@query("ag16_distinct_values", "SELECT DISTINCT category FROM noteevents")
def _(t):
    return t.noteevents.select("category").distinct().orderBy("category")


@query(
    "ag17_rates",
    """SELECT o_orderpriority, ceil(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE * 100) AS up,
              round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE * 100, 2) AS pct FROM orders GROUP BY 1""",
)
def _(t):
    hits = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_orderpriority").agg(
        sc.percent_up(hits, F.count(F.lit(1))).alias("up"), sc.percent(hits, F.count(F.lit(1))).alias("pct")
    )


# ---- windows, order, sets ---------------------------------------------------


@query(
    "wn01_next_in_time",
    """SELECT event_id, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_ts FROM events""",
)
def _(t):
    return ordered.next_in_time(t.events, ["user_id", "event_type"], "ts", "event_id", "next_ts").select("event_id", "next_ts")


@query(
    "wn02_share_of_total",
    "SELECT o_orderpriority, round(count(*) / (sum(count(*)) OVER ())::DOUBLE * 100, 2) AS share FROM orders GROUP BY 1",
)
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = ordered.over_all(F.sum("n"))
    return counts.select("o_orderpriority", sc.percent(F.col("n"), total).alias("share"))


@query(
    "wn04_first_rows",
    """SELECT o_custkey, o_orderkey, rn::INT AS rn FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def _(t):
    return ordered.first_rows(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rn")


@query("st02_top_ten", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "se01_bag_union",
    "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def _(t):
    one = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return one.unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query(
    "se02_columns_side_by_side",
    """SELECT c.c_custkey, c.c_acctbal, o.n_orders FROM customer c
       JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""",
)
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.select("c_custkey", "c_acctbal").join(counts, "c_custkey")


@query(
    "se03_list_union",
    """SELECT case_id, array_to_string(list_sort(list_distinct(list_filter([symptom_1, symptom_2, symptom_2, symptom_5], lambda s: s IS NOT NULL))), '|') AS merged
       FROM cases""",
)
def _(t):
    both = F.array_union(F.array("symptom_1", "symptom_2"), F.array("symptom_2", "symptom_5"))
    return t.cases.select("case_id", F.array_join(F.array_sort(F.array_compact(both)), "|").alias("merged"))


# ---- scalar functions -------------------------------------------------------


@query(
    "fn01_dates",
    f"""SELECT hadm_id, date_diff('day', admittime, dischtime)::INT AS days, (year(admittime) - year(dob))::INT AS boundaries,
               {AGE} AS age, year(admittime)::INT AS y, hour(admittime)::INT AS h, (isodow(admittime) - 1)::INT AS weekday,
               date_diff('microsecond', admittime, dischtime) / 3.6e9 AS hours, admittime + INTERVAL 48 HOUR AS plus48
        FROM admissions JOIN patients USING (subject_id)""",
)
def _(t):
    return t.admissions.join(t.patients, "subject_id").select(
        "hadm_id",
        sc.days_between("dischtime", "admittime").alias("days"),
        sc.year_boundaries("admittime", "dob").alias("boundaries"),
        sc.completed_years("admittime", "dob").alias("age"),
        F.year("admittime").alias("y"),
        F.hour("admittime").alias("h"),
        F.weekday("admittime").alias("weekday"),
        sc.hours_between("dischtime", "admittime").alias("hours"),
        sc.add_hours("admittime", 48).alias("plus48"),
    )


@query(
    "fn05_parse_time",
    """SELECT o_orderkey, try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END,
                                       '%Y-%m-%d %H:%M:%S') AS at FROM orders""",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", sc.parse_time(text, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "fn08_age_labels",
    """SELECT subject_id, CASE WHEN d10 = 300 THEN 90 WHEN d10 > 300 THEN 95 ELSE d10 END AS decade,
              CASE WHEN d10 = 300 THEN '90+' WHEN d10 > 300 THEN '95+' ELSE concat(d10::VARCHAR, 's') END AS label
       FROM (SELECT subject_id, (floor((2010 - year(dob)) / 10.0) * 10)::BIGINT AS d10 FROM patients)""",
)
def _(t):
    years = F.lit(2010) - F.year("dob")
    return t.patients.select("subject_id", sc.age_decade(years).alias("decade"), sc.age_decade_label(years).alias("label"))


@query(
    "fn12_numbers_in_text",
    """SELECT dose_val_rx, nullif(regexp_extract(dose_val_rx, '[0-9]+'), '')::DOUBLE AS digits, try_cast(dose_val_rx AS DOUBLE) AS number,
              count(*) AS n FROM prescriptions GROUP BY 1""",
)
def _(t):
    return t.prescriptions.groupBy("dose_val_rx").agg(F.count(F.lit(1)).alias("n")).select(
        "dose_val_rx", sc.first_digits("dose_val_rx").alias("digits"), sc.lenient_number("dose_val_rx").alias("number"), "n"
    )


@query(
    "fn15_text",
    r"""SELECT turn_id, lower(trim(split_part(text, '.', 1))) AS head, substr(text, 1, 5) AS start, concat_ws(':', role, turn) AS tag FROM turns""",
)
def _(t):
    return t.turns.select(
        "turn_id",
        F.lower(F.trim(sc.first_sentence("text"))).alias("head"),
        F.substring("text", 1, 5).alias("start"),
        F.concat_ws(":", "role", "turn").alias("tag"),
    )


@query(
    "fn17_guarded_ratios",
    """SELECT event_id, CASE WHEN value > 50 THEN round((value - (value - 50)) / (value - 50) * 100, 4) ELSE 0 END AS rise,
              CASE WHEN event_id % 5 > 0 THEN round(value * (24.0 / (event_id % 5)), 4) ELSE 0 END AS per_day FROM events""",
)
def _(t):
    base = F.col("value") - 50
    return t.events.select(
        "event_id",
        F.round(sc.rise_percent(F.col("value"), base), 4).alias("rise"),
        F.round(sc.per_day("value", F.col("event_id") % 5), 4).alias("per_day"),
    )


@query(
    "ud04_many_rows_per_document",
    r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


