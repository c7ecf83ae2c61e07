"""Model evaluation EV-1 to EV-16 and the rule-based scores ML-13 to ML-17."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.plans import evaluation as e


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(
    "ev01_confusion_matrix",
    """SELECT a AS actual, b AS predicted, count(case_id) AS n
       FROM (SELECT a::INT AS a, b::INT AS b FROM range(0, 2) x(a), range(0, 2) y(b))
       LEFT JOIN scored ON label = a AND (p_net >= 0.5)::INT = b GROUP BY 1, 2""",
)
def _(t):
    return e.confusion_matrix(t.scored, "label", e.predicted("p_net"))


@query(
    "ev01_confusion_matrix_strict",
    """SELECT a AS actual, b AS predicted, count(case_id) AS n
       FROM (SELECT a::INT AS a, b::INT AS b FROM range(0, 2) x(a), range(0, 2) y(b))
       LEFT JOIN scored ON label = a AND (p_net > 0.5)::INT = b GROUP BY 1, 2""",
)
def _(t):
    return e.confusion_matrix(t.scored, "label", e.predicted("p_net", strict=True))


def _report(rows: str) -> str:
    return f"""
        WITH r AS ({rows}),
        per AS (SELECT c AS class, (SELECT count(*) FROM r WHERE y = c AND p = c) AS hit,
                       (SELECT count(*) FROM r WHERE p = c) AS said, (SELECT count(*) FROM r WHERE y = c) AS support
                FROM (SELECT y AS c FROM r UNION SELECT p FROM r)),
        m AS (SELECT class, support, CASE WHEN said = 0 THEN 0 ELSE hit / said::DOUBLE END AS precision,
                     CASE WHEN support = 0 THEN 0 ELSE hit / support::DOUBLE END AS recall,
                     CASE WHEN said + support = 0 THEN 0 ELSE 2 * hit / (said + support)::DOUBLE END AS f1, hit FROM per)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support)::DOUBLE, 6), round(sum(hit) / sum(support)::DOUBLE, 6),
               round(sum(hit) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m"""


@query(
    "ev02_classification_report",
    _report("SELECT label::VARCHAR AS y, (p_forest >= 0.5)::INT::VARCHAR AS p FROM scored"),
)
def _(t):
    return _rounded(
        e.classification_report(t.scored, "label", e.predicted("p_forest")), "precision", "recall", "f1"
    )


@query(
    "ev02_classification_report_many_classes",
    _report(
        """SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0
             THEN 'UNSEEN' ELSE o_orderpriority END AS p FROM orders"""
    ),
)
def _(t):
    guess = (
        F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT")
        .when(F.col("o_orderkey") % 7 == 0, "UNSEEN")
        .otherwise(F.col("o_orderpriority"))
    )
    return _rounded(e.classification_report(t.orders, "o_orderpriority", guess), "precision", "recall", "f1")


def _auc(score: str, table: str = "scored", label: str = "label") -> str:
    return f"""
        SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
               / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)) AS auc,
               count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives
        FROM (SELECT {label} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2 AS rk
              FROM {table} WHERE {score} IS NOT NULL)"""


for model in ("net", "forest"):

    @query(
        f"ev03_roc_auc_{model}",
        f"SELECT round(auc, 9) AS auc, positives, negatives FROM ({_auc('p_' + model)})",
    )
    def _(t, model=model):
        return e.roc_auc(t.scored, "label", f"p_{model}").withColumn("auc", F.round("auc", 9))


@query(
    "ev03_roc_auc_price",
    f"""SELECT round(auc, 9) AS auc, positives, negatives
        FROM ({_auc("l_extendedprice", "lineitem", "(l_returnflag = 'R')::INT")})""",
)
def _(t):
    flagged = t.lineitem.select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return e.roc_auc(flagged, "y", "l_extendedprice").withColumn("auc", F.round("auc", 9))


CURVE = """
    WITH g AS (SELECT p_net AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
                      count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
    w AS (SELECT threshold, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS p,
                 sum(neg) OVER () AS n, lead(pos) OVER d AS np, lead(neg) OVER d AS nn, row_number() OVER d AS rn
          FROM g WINDOW d AS (ORDER BY threshold DESC)),
    full_curve AS (SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
              UNION ALL SELECT threshold, fp / n::DOUBLE, tp / p::DOUBLE FROM w),
    curve AS (SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
              UNION ALL SELECT threshold, fp / n::DOUBLE, tp / p::DOUBLE FROM w
              WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg) """


@query("ev04_roc_curve", CURVE + "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def _(t):
    return _rounded(e.roc_curve(t.scored, "label", "p_net"), "fpr", "tpr")


@query(
    "ev04_roc_curve_all_points",
    CURVE + "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM full_curve",
)
def _(t):
    return _rounded(e.roc_curve(t.scored, "label", "p_net", drop_collinear=False), "fpr", "tpr")


@query(
    "ev05_operating_points",
    CURVE
    + """SELECT mark, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr
         FROM (SELECT mark::DOUBLE AS mark, curve.*, row_number() OVER (PARTITION BY mark
                        ORDER BY abs(threshold - mark::DOUBLE), threshold DESC) AS rn
               FROM curve, (VALUES (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8)) v(mark)
               WHERE threshold IS NOT NULL) WHERE rn = 1""",
)
def _(t):
    return _rounded(e.operating_points(e.roc_curve(t.scored, "label", "p_net")), "fpr", "tpr")


@query(
    "ev06_agreement_rate",
    "SELECT round(avg((abs(p_net - p_forest) < 0.2)::INT) * 100, 6) AS agreement_percent FROM scored",
)
def _(t):
    return _rounded(e.agreement_rate(t.scored, "p_net", "p_forest"), "agreement_percent")


@query(
    "ev07_error_table",
    """SELECT category, count(case_id) AS n, round(100.0 * count(case_id) / (SELECT count(*) FROM scored), 6) AS percentage
       FROM (VALUES ('Both Models Correct', TRUE, TRUE), ('Both Models Wrong', FALSE, FALSE),
                    ('Only DL Correct', TRUE, FALSE), ('Only RF Correct', FALSE, TRUE)) v(category, a, b)
       LEFT JOIN scored ON ((p_net >= 0.5)::INT = label) = a AND ((p_forest >= 0.5)::INT = label) = b GROUP BY 1""",
)
def _(t):
    return _rounded(e.error_table(t.scored, "label", "p_net", "p_forest"), "percentage")


FOUND = """
    SELECT case_type, case_id, p_net, p_forest, CASE WHEN label = 1 THEN 'Died' ELSE 'Survived' END AS outcome
    FROM (SELECT 'Strong Disagreement' AS case_type, * FROM scored WHERE abs(p_net - p_forest) > 0.4
          UNION ALL SELECT 'DL False Positive', * FROM scored WHERE p_net >= 0.5 AND label = 0
          UNION ALL SELECT 'DL False Negative', * FROM scored WHERE p_net < 0.5 AND label = 1
          UNION ALL SELECT 'RF False Positive', * FROM scored WHERE p_forest >= 0.5 AND label = 0
          UNION ALL SELECT 'RF False Negative', * FROM scored WHERE p_forest < 0.5 AND label = 1)"""


@query("ev08_case_finder", FOUND)
def _(t):
    return e.case_finder(t.scored, "case_id", "label", "p_net", "p_forest")


@query(
    "ev08_case_studies",
    f"SELECT * FROM ({FOUND}) QUALIFY row_number() OVER (PARTITION BY case_type ORDER BY case_id) = 1",
)
def _(t):
    return e.case_studies(e.case_finder(t.scored, "case_id", "label", "p_net", "p_forest"), "case_id")


@query(
    "ev09_auc_verdict",
    f"""SELECT round(a.auc, 9) AS auc_a, round(b.auc, 9) AS auc_b,
               CASE WHEN a.auc > b.auc + 0.05 THEN 'first substantially better' WHEN a.auc > b.auc THEN 'first slightly better'
                    WHEN a.auc < b.auc - 0.05 THEN 'second substantially better' WHEN a.auc < b.auc THEN 'second slightly better'
                    ELSE 'similar' END AS verdict,
               CASE WHEN a.auc > b.auc THEN 'first' ELSE 'second' END AS prefer
        FROM ({_auc("p_net")}) a, ({_auc("p_forest")}) b""",
)
def _(t):
    out = e.auc_verdict(
        e.roc_auc(t.scored, "label", "p_net"), e.roc_auc(t.scored, "label", "p_forest")
    )
    return out.withColumn("auc_a", F.round("auc_a", 9)).withColumn("auc_b", F.round("auc_b", 9))


EDGES = " + ".join(f"(p_forest > {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))


@query(
    "ev10_calibration_curve",
    f"""SELECT ({EDGES})::INT AS bin, round(avg(label), 6) AS fraction_positive,
               round(avg(p_forest), 6) AS mean_score, count(*) AS n FROM scored GROUP BY 1""",
)
def _(t):
    return _rounded(
        e.calibration_curve(t.scored, "label", "p_forest"), "fraction_positive", "mean_score"
    )


@query(
    "ev11_risk_stratification",
    """SELECT position::INT AS position, risk, count(case_id) AS cases,
              round(coalesce(avg(label), 0) * 100, 6) AS rate_percent
       FROM (VALUES (0, 'Very Low', 0.0, 0.2), (1, 'Low', 0.2, 0.4), (2, 'Moderate', 0.4, 0.6),
                    (3, 'High', 0.6, 0.8), (4, 'Very High', 0.8, 1.0)) v(position, risk, lo, hi)
       LEFT JOIN scored ON p_forest >= lo::DOUBLE AND p_forest < hi::DOUBLE GROUP BY 1, 2""",
)
def _(t):
    return _rounded(e.risk_stratification(t.scored, "label", "p_forest"), "rate_percent")


ACTION = """CASE WHEN p_net < 0.3::DOUBLE THEN 'Standard Care' WHEN p_net < 0.6::DOUBLE THEN 'Close Monitoring'
            ELSE 'Immediate Intervention' END"""


@query(
    "ev12_decision_table",
    f"""SELECT case_id, p_net, recommendation, CASE WHEN label = 1 THEN 'Expired' ELSE 'Survived' END AS outcome,
               (p_net >= 0.5)::INT <> label AS misclassified
        FROM (SELECT *, {ACTION} AS recommendation FROM scored)
        QUALIFY row_number() OVER (PARTITION BY recommendation ORDER BY case_id) <= 5""",
)
def _(t):
    return e.decision_table(t.scored, "case_id", "label", "p_net")


@query(
    "ev13_quadrants",
    """SELECT a AS first_predicts, b AS second_predicts, count(case_id) AS n
       FROM (SELECT a::INT AS a, b::INT AS b FROM range(0, 2) x(a), range(0, 2) y(b))
       LEFT JOIN scored ON (p_net >= 0.5)::INT = a AND (p_forest >= 0.5)::INT = b GROUP BY 1, 2""",
)
def _(t):
    return e.quadrants(t.scored, "p_net", "p_forest")


def _guesses(t):
    """Two answer columns over the case table: one echoes the class in capitals, one a symptom."""
    return t.cases.select(
        "case_id",
        "disease",
        F.when(F.col("case_id") % 4 != 0, F.upper("disease")).otherwise("ERROR").alias("first"),
        F.when(F.col("case_id") % 3 == 0, F.col("disease")).otherwise("unknown").alias("second"),
    )


GUESSES = """
    SELECT case_id, disease, CASE WHEN case_id % 4 <> 0 THEN upper(disease) ELSE 'ERROR' END AS first,
           CASE WHEN case_id % 3 = 0 THEN disease ELSE 'unknown' END AS second FROM cases"""


@query(
    "ev14_accuracy",
    f"SELECT count(*) AS cases, round(avg((lower(first) = lower(disease))::INT), 6) AS accuracy FROM ({GUESSES})",
)
def _(t):
    return _rounded(e.accuracy(_guesses(t), "disease", "first"), "accuracy")


@query(
    "ev15_compare_methods",
    f"""SELECT *, lower(first) = lower(disease) AS first_correct, lower(second) = lower(disease) AS second_correct
        FROM ({GUESSES})""",
)
def _(t):
    return e.compare_methods(_guesses(t), "case_id", "disease", "first", "second")


@query(
    "ev15_method_winner",
    f"""SELECT round(a, 6) AS first_accuracy, round(b, 6) AS second_accuracy,
               CASE WHEN b > a THEN 'second' WHEN a > b THEN 'first' ELSE 'equal' END AS winner
        FROM (SELECT avg((lower(first) = lower(disease))::INT) AS a, avg((lower(second) = lower(disease))::INT) AS b
              FROM ({GUESSES}))""",
)
def _(t):
    out = e.method_winner(e.compare_methods(_guesses(t), "case_id", "disease", "first", "second"))
    return _rounded(out, "first_accuracy", "second_accuracy")


@query(
    "ev16_case_summary",
    """SELECT hadm_id AS case_id, gender, ethnicity, admission_type, diagnosis, p_net, p_forest,
              (p_net + p_forest) / 2 AS p_ensemble, CASE WHEN label = 1 THEN 'Expired' ELSE 'Survived' END AS outcome
       FROM admissions a JOIN patients p ON a.subject_id = p.subject_id JOIN scored s ON s.case_id = a.hadm_id""",
)
def _(t):
    cases = t.admissions.join(t.patients, "subject_id").select(
        F.col("hadm_id").alias("case_id"), "gender", "ethnicity", "admission_type", "diagnosis"
    )
    return e.case_summary(cases, t.scored, "case_id", "p_net", "p_forest", "label")


# ---- rule-based scores ------------------------------------------------------


@query("ml13_ensemble", "SELECT *, (p_net + p_forest) / 2 AS p_ensemble FROM scored")
def _(t):
    return e.ensemble(t.scored, "p_net", "p_forest")


@query(
    "ml14_clinical_score",
    """SELECT case_id, score, CASE WHEN score >= 6 THEN 'Very High' WHEN score >= 4 THEN 'High' WHEN score >= 3 THEN 'Moderate'
                                  WHEN score >= 1 THEN 'Low' ELSE 'Very Low' END AS category
       FROM (SELECT l_orderkey * 10 + l_linenumber AS case_id,
                    (CASE WHEN l_partkey % 100 > 80 THEN 4 WHEN l_partkey % 100 > 65 THEN 3 WHEN l_partkey % 100 > 50 THEN 2
                          WHEN l_partkey % 100 > 35 THEN 1 ELSE 0 END
                     + least(3, (l_quantity NOT BETWEEN 11 AND 16)::INT
                                + (l_extendedprice / 1000 NOT BETWEEN 20 AND 30)::INT
                                + (l_suppkey NOT BETWEEN 95 AND 105)::INT))::INT AS score FROM lineitem)""",
)
def _(t):
    raw = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"),
        (F.col("l_partkey") % 100).alias("age"),
        F.col("l_quantity").alias("hemoglobin"),
        (F.col("l_extendedprice") / 1000).alias("bun"),
        F.col("l_suppkey").alias("glucose"),
    )
    score = e.clinical_score("age", ["hemoglobin", "bun", "glucose"])
    return raw.select("case_id", score.alias("score"), e.clinical_category(score).alias("category"))


@query("ml15_score_action", f"SELECT case_id, p_net, {ACTION} AS recommendation FROM scored")
def _(t):
    return t.scored.select("case_id", "p_net", e.action("p_net").alias("recommendation"))


@query(
    "ml16_demo_action",
    """SELECT case_id, p_net, CASE WHEN p_net > 0.6::DOUBLE THEN 'High' WHEN p_net > 0.3::DOUBLE THEN 'Moderate' ELSE 'Low' END AS category,
              CASE WHEN p_net > 0.6::DOUBLE THEN 'Immediate Intervention' WHEN p_net > 0.3::DOUBLE THEN 'Close Monitoring'
                   ELSE 'Standard Care' END AS recommendation FROM scored""",
)
def _(t):
    return t.scored.select(
        "case_id", "p_net", e.demo_category("p_net").alias("category"), e.demo_action("p_net").alias("recommendation")
    )




@query(
    "ml17_lab_flags",
    """SELECT l.itemid, count(*) AS readings, count(*) FILTER (WHERE valuenum < lo OR valuenum > hi) AS abnormal
       FROM labevents l LEFT JOIN (
         SELECT s_suppkey % 20 AS itemid, min(s_suppkey % 5)::DOUBLE / 5 AS lo, min(s_suppkey % 5)::DOUBLE / 5 + 1 AS hi
         FROM supplier GROUP BY 1) r ON l.itemid = r.itemid GROUP BY 1""",
)
def _(t):
    ranges = (
        t.supplier.groupBy((F.col("s_suppkey") % 20).alias("itemid"))
        .agg((F.min(F.col("s_suppkey") % 5).cast("double") / 5).alias("lo"))
        .withColumn("hi", F.col("lo") + 1)
    )
    flagged = e.lab_flags(t.labevents, ranges)
    return flagged.groupBy("itemid").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("abnormal")).alias("abnormal")
    )
