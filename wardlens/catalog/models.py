"""Feature preparation ML-1 to ML-6 and ML-11, fitted models ML-7 to ML-12, ML-18 and TS-12."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.catalog.stays import MODEL_FRAME, model_frame, sequences
from wardlens.operators.shape import fill_medians, scale_standard
from wardlens.plans import evaluation as e
from wardlens.plans import features as f
from wardlens.plans import models as m
from wardlens.plans import stays as s
from wardlens.session import cut_lineage


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


FILLED = ", ".join(
    f"round(coalesce({c}::DOUBLE, median({c}::DOUBLE) OVER ()), 6) AS {c}" for c in s.MODEL_COLUMNS
)


@query("ml01_median_imputation", f"SELECT icustay_id, {FILLED}, label FROM ({MODEL_FRAME})")
def _(t):
    return _rounded(fill_medians(model_frame(t), s.MODEL_COLUMNS), *s.MODEL_COLUMNS)


@query(
    "ml02_standard_scaling",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
              round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
              round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount
       FROM lineitem""",
)
def _(t):
    cols = ["l_quantity", "l_discount"]
    kept = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *cols)
    return _rounded(scale_standard(kept, cols), *cols)


@query(
    "ml03_split_rows",
    """SELECT o_orderkey, CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) < 900719925474099 AS is_test FROM orders""",
)
def _(t):
    return f.split_rows(t.orders.select("o_orderkey"), "o_orderkey")


MIXED = "CAST('0x' || substr(md5('42:' || CAST(case_id AS VARCHAR)), 1, 13) AS BIGINT)"
STRATIFIED = f"""
    SELECT case_id, disease, row_number() OVER (PARTITION BY disease ORDER BY {MIXED}, case_id)
             <= floor(0.2 * count(*) OVER (PARTITION BY disease) + 1e-9) AS is_test FROM cases"""


@query("ml04_split_stratified", STRATIFIED)
def _(t):
    return f.split_stratified(cut_lineage(t.cases.select("case_id", "disease")), "case_id", "disease")


@query(
    "ml05_split_positional",
    """SELECT event_id, row_number() OVER (ORDER BY event_id) <= floor(0.8 * count(*) OVER () + 1e-9) AS is_train
       FROM events""",
)
def _(t):
    return f.split_positional(t.events.select("event_id"), "event_id")


@query(
    "ml06_seeded_shuffle",
    "SELECT event_id, CAST('0x' || substr(md5('42:' || CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) AS shuffle_key FROM events",
)
def _(t):
    return f.shuffled(t.events.select("event_id"), "event_id")


@query(
    "ml08_class_weights",
    """SELECT label, count(*) AS n, round(any_value(total) / (2.0 * count(*)), 6) AS weight
       FROM (SELECT label, count(*) OVER () AS total FROM scored) GROUP BY 1""",
)
def _(t):
    counts = t.scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(counts.join(f.class_weights(t.scored, "label"), "label"), "weight")


def _forest(t, **options):
    frame = f.split_rows(m.prepared(model_frame(t), s.MODEL_COLUMNS), "icustay_id")
    model = m.forest(frame.where(~F.col("is_test")), s.MODEL_COLUMNS, **options)
    return model, frame


@query("ml07_forest_scores")
def _(t):
    model, frame = _forest(t, trees=100, depth=20)
    return m.with_probability(model, frame, keep=["icustay_id", "is_test", "label"])


@query("ml08_balanced_forest_scores")
def _(t):
    model, frame = _forest(t, trees=100, depth=10, min_leaf=2, balanced=True)
    return m.with_probability(model, frame, keep=["icustay_id", "is_test", "label"])


@query("ml09_held_out_report")
def _(t):
    model, frame = _forest(t, trees=100, depth=20)
    held = m.with_probability(model, frame.where("is_test"), keep=["icustay_id", "label"])
    return e.classification_report(held, "label", e.predicted("p"))


@query("ml10_feature_importance")
def _(t):
    model, _frame = _forest(t, trees=100, depth=20)
    return m.top_features(m.feature_importance(model, s.MODEL_COLUMNS, t.spark))


LABS = ", ".join(f"avg(valuenum) FILTER (WHERE itemid = {i}) AS lab_{i}" for i in range(20))
MULTIMODAL = f"""
    SELECT a.hadm_id, a.subject_id, admittime, hospital_expire_flag, gender,
           (year(admittime) - year(dob) - CASE WHEN (month(admittime), day(admittime)) < (month(dob), day(dob))
                                              THEN 1 ELSE 0 END)::INT AS age, l.* EXCLUDE (hadm_id), text, charttime,
           date_diff('microsecond', admittime, charttime) / 3.6e9 AS hours_from_admission
    FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id
    LEFT JOIN (SELECT hadm_id, {LABS} FROM labevents WHERE hadm_id IS NOT NULL AND itemid IN
                 (SELECT itemid FROM labevents GROUP BY 1 ORDER BY count(*) DESC, itemid LIMIT 20)
               GROUP BY hadm_id) l ON l.hadm_id = a.hadm_id
    JOIN (SELECT hadm_id, arg_min(text, row(charttime IS NULL, charttime, row_id)) FILTER (WHERE text IS NOT NULL) AS text,
                 min(charttime) AS charttime FROM noteevents GROUP BY 1) n ON n.hadm_id = a.hadm_id
    WHERE regexp_matches(diagnosis, '(?i)\\bsepsis\\b') AND text IS NOT NULL"""


@query(
    "ml11_multimodal_table",
    f"SELECT * REPLACE (round(hours_from_admission, 6) AS hours_from_admission, "
    + ", ".join(f"round(lab_{i}, 6) AS lab_{i}" for i in range(20))
    + f") FROM ({MULTIMODAL})",
)
def _(t):
    table = f.multimodal(t.admissions, t.patients, t.labevents, t.noteevents)
    return _rounded(table, "hours_from_admission", *f.lab_columns(table))


def _fused(t):
    table = f.multimodal(t.admissions, t.patients, t.labevents, t.noteevents)
    labs = f.lab_columns(table)
    structured = ["age", "gender_F", "gender_M", *labs]
    ready = m.prepared(f.gender_dummies(table), structured, standard=True).withColumn(
        "label", F.col("hospital_expire_flag")
    )
    split = f.split_positional(ready, "hadm_id")
    model = m.fused_classifier(split.where("is_train"), structured, dims=64, hidden=(16,), rounds=20)
    return model, split


@query("ml12_fused_scores")
def _(t):
    model, split = _fused(t)
    return m.with_probability(model, split, keep=["hadm_id", "is_train", "label"])


@query("ml18_loss_history")
def _(t):
    model, _split = _fused(t)
    return m.loss_history(model, t.spark)


@query(
    "ml16_mean_vector_default",
    """SELECT vec_id, round(v, 6) AS first_value FROM (
         SELECT vec_id, CASE WHEN label = 3 THEN avg(CASE WHEN label <> 3 THEN embedding[1]::DOUBLE END) OVER ()
                             ELSE embedding[1]::DOUBLE END AS v FROM embeddings)""",
)
def _(t):
    some = t.embeddings.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    return m.score_with_default_vector(some, "embedding", 64).select(
        "vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first_value")
    )


@query("ts12_sequence_scores")
def _(t):
    vectors = m.sequence_vectors(s.scaled_sequences(sequences(t)), s.SEQUENCE_FEATURES)
    split = f.split_rows(cut_lineage(vectors), "icustay_id")
    model = m.sequence_classifier(split.where(~F.col("is_test")), 36, hidden=(16,), rounds=30)
    return m.with_probability(model, split, keep=["icustay_id", "is_test", "label"])
