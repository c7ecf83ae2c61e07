"""Exploratory tables EX-1 to EX-6."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.plans import explore as x


@query(
    "ex01_stays_by_hour",
    """SELECT h.hour, u.first_careunit, coalesce(n, 0) AS stays,
              coalesce(n, 0) >= 0.9 * max(coalesce(n, 0)) OVER () AS is_peak
       FROM (SELECT DISTINCT hour(intime)::INT AS hour FROM icustays) h
       CROSS JOIN (SELECT DISTINCT first_careunit FROM icustays) u
       LEFT JOIN (SELECT hour(intime) AS hour, first_careunit, count(*) AS n FROM icustays GROUP BY 1, 2) c
         ON c.hour = h.hour AND c.first_careunit = u.first_careunit""",
)
def _(t):
    return x.stays_by_hour(t.icustays)


@query(
    "ex02_stay_trend",
    """SELECT year, first_careunit, round(mean_los, 6) AS mean_los, stays,
              round(stays / (max(stays) OVER ())::DOUBLE * max(mean_los) OVER (), 6) AS scaled_volume
       FROM (SELECT year(intime)::INT AS year, first_careunit, avg(los) AS mean_los, count(*) AS stays
             FROM icustays GROUP BY 1, 2)""",
)
def _(t):
    return (
        x.stay_trend(t.icustays)
        .withColumn("mean_los", F.round("mean_los", 6))
        .withColumn("scaled_volume", F.round("scaled_volume", 6))
    )


@query(
    "ex03_outcome_by_insurance",
    """SELECT insurance, round(avg(hospital_expire_flag), 6) AS mortality_rate,
              round(1 - avg(hospital_expire_flag), 6) AS survival_rate, count(*) AS total_patients
       FROM admissions GROUP BY 1""",
)
def _(t):
    return (
        x.outcome_by_insurance(t.admissions)
        .withColumn("mortality_rate", F.round("mortality_rate", 6))
        .withColumn("survival_rate", F.round("survival_rate", 6))
    )


def _trimmed(k: int) -> str:
    """Naive statement of the trimmed matrix: columns lab_1..lab_k in order of frequency."""
    means = ", ".join(f"avg(v) FILTER (WHERE rk = {i}) AS lab_{i}" for i in range(1, k + 1))
    steps, last = "", "m0"
    for i in range(1, k + 1):
        steps += f""", m{i} AS (SELECT * FROM {last} WHERE lab_{i} BETWEEN
            (SELECT quantile_cont(lab_{i}, 0.01) FROM {last}) AND (SELECT quantile_cont(lab_{i}, 0.99) FROM {last}))"""
        last = f"m{i}"
    return f"""
        WITH top AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rk
                     FROM labevents l JOIN d_labitems i ON l.itemid = i.itemid GROUP BY label
                     QUALIFY rk <= {k}),
        m0 AS (SELECT p.*, a.hospital_expire_flag AS mortality
               FROM (SELECT hadm_id, {means}
                     FROM (SELECT hadm_id, rk, try_cast(value AS DOUBLE) AS v FROM labevents l
                           JOIN d_labitems i ON l.itemid = i.itemid JOIN top ON top.label = i.label
                           WHERE value IS NOT NULL AND hadm_id IS NOT NULL) GROUP BY hadm_id) p
               LEFT JOIN admissions a ON a.hadm_id = p.hadm_id){steps} """


@query(
    "ex04_lab_matrix",
    _trimmed(3)
    + "SELECT hadm_id, round(lab_1, 6) AS lab_1, round(lab_2, 6) AS lab_2, round(lab_3, 6) AS lab_3, mortality FROM m3",
)
def _(t):
    m, labels = x.trimmed_lab_matrix(t.labevents, t.d_labitems, t.admissions, 3)
    return m.select(
        "hadm_id",
        *[F.round(c, 6).alias(f"lab_{i}") for i, c in enumerate(labels, 1)],
        "mortality",
    )


@query(
    "ex04_lab_matrix_top5_untrimmed",
    _trimmed(5)
    + """SELECT hadm_id, round(lab_1, 6) AS lab_1, round(lab_2, 6) AS lab_2, round(lab_3, 6) AS lab_3,
                round(lab_4, 6) AS lab_4, round(lab_5, 6) AS lab_5, mortality FROM m0""",
)
def _(t):
    labels = x.top_labels(t.labevents, t.d_labitems, 5)
    m = x.lab_matrix(t.labevents, t.d_labitems, t.admissions, labels)
    return m.select(
        "hadm_id",
        *[F.round(c, 6).alias(f"lab_{i}") for i, c in enumerate(labels, 1)],
        "mortality",
    )


DENSE = _trimmed(5).replace("labevents", "ward_labs")


def _dense(t):
    """Trimmed matrix over pooled admissions, where all five labels are usually present."""
    m, labels = x.trimmed_lab_matrix(t.ward_labs, t.d_labitems, t.admissions, 5)
    return m.select("hadm_id", "mortality", *[F.col(c).alias(f"lab_{i}") for i, c in enumerate(labels, 1)])


FIVE = [f"lab_{i}" for i in range(1, 6)]


@query(
    "ex04_lab_matrix_top5",
    DENSE + "SELECT hadm_id, mortality, " + ", ".join(f"round({c}, 6) AS {c}" for c in FIVE) + " FROM m5",
)
def _(t):
    return _dense(t).select("hadm_id", "mortality", *[F.round(c, 6).alias(c) for c in FIVE])


@query(
    "ex05_pair_correlations_top5",
    DENSE
    + " UNION ALL ".join(
        f"""SELECT mortality, '{a}' AS x, '{b}' AS y, count(*) AS n, CASE WHEN count(*) > 2 THEN round(corr({a}, {b}), 6) END AS corr
            FROM m5 GROUP BY mortality"""
        for i, a in enumerate(FIVE)
        for b in FIVE[i + 1 :]
    ),
)
def _(t):
    out = x.pair_correlations(_dense(t), FIVE, "mortality")
    return out.withColumn("corr", F.when(F.col("n") > 2, F.round("corr", 6)))


@query(
    "ex05_histograms_top5",
    DENSE
    + " UNION ALL ".join(
        f"""SELECT mortality, '{c}' AS "column", least(floor(({c} - lo) / nullif(hi - lo, 0) * 10), 9)::INT AS bin, count(*) AS n
            FROM m5, (SELECT min({c}) AS lo, max({c}) AS hi FROM m5) GROUP BY ALL"""
        for c in FIVE
    ),
)
def _(t):
    return x.histograms(_dense(t), FIVE, "mortality")


PAIRS = [(1, 2), (1, 3), (2, 3)]


@query(
    "ex05_pair_correlations",
    _trimmed(3)
    + " UNION ALL ".join(
        f"""SELECT mortality, 'lab_{a}' AS x, 'lab_{b}' AS y, count(*) AS n,
                   CASE WHEN count(*) > 2 THEN round(corr(lab_{a}, lab_{b}), 6) END AS corr
            FROM m3 GROUP BY mortality"""
        for a, b in PAIRS
    ),
)
def _(t):
    m, labels = x.trimmed_lab_matrix(t.labevents, t.d_labitems, t.admissions, 3)
    names = [f"lab_{i}" for i in range(1, 4)]
    renamed = m.select("mortality", *[F.col(c).alias(n) for c, n in zip(labels, names)])
    out = x.pair_correlations(renamed, names, "mortality")
    return out.withColumn("corr", F.when(F.col("n") > 2, F.round("corr", 6)))


@query(
    "ex05_histograms",
    _trimmed(3)
    + " UNION ALL ".join(
        f"""SELECT mortality, 'lab_{i}' AS "column", least(floor((lab_{i} - lo) / nullif(hi - lo, 0) * 10), 9)::INT AS bin,
                   count(*) AS n
            FROM m3, (SELECT min(lab_{i}) AS lo, max(lab_{i}) AS hi FROM m3) GROUP BY ALL"""
        for i in range(1, 4)
    ),
)
def _(t):
    m, labels = x.trimmed_lab_matrix(t.labevents, t.d_labitems, t.admissions, 3)
    names = [f"lab_{i}" for i in range(1, 4)]
    renamed = m.select("mortality", *[F.col(c).alias(n) for c, n in zip(labels, names)])
    return x.histograms(renamed, names, "mortality")


CONTEXT = """
    SELECT insurance, los, CASE WHEN k <= 0 THEN NULL WHEN k <= 18 THEN '0-18' WHEN k <= 40 THEN '19-40'
             WHEN k <= 65 THEN '41-65' WHEN k <= 90 THEN '66-90' ELSE '90+' END AS age_group,
           CASE WHEN n > 1 THEN 'Readmitted' ELSE 'First-Time' END AS readmission_status
    FROM (SELECT insurance, los, a.subject_id % 100 AS k, count(*) OVER (PARTITION BY a.subject_id) AS n
          FROM (SELECT a.*, los FROM admissions a LEFT JOIN icustays i ON a.hadm_id = i.hadm_id) a)"""


def _spread(by: str) -> str:
    return f"""SELECT {by}, count(los) AS stays, round(avg(los), 6) AS mean_los,
                      round(quantile_cont(los, 0.25), 6) AS q1, round(median(los), 6) AS median,
                      round(quantile_cont(los, 0.75), 6) AS q3
               FROM ({CONTEXT}) GROUP BY ALL"""


def _rounded(df):
    return df.select(
        *[F.round(c, 6).alias(c) if c in ("mean_los", "q1", "median", "q3") else c for c in df.columns]
    )


for suffix, keys in (
    ("by_insurance", ["insurance"]),
    ("by_age", ["insurance", "age_group"]),
    ("by_readmission", ["insurance", "readmission_status"]),
    ("by_all", ["insurance", "age_group", "readmission_status"]),
):

    @query(f"ex06_stay_spread_{suffix}", _spread(", ".join(keys)))
    def _(t, keys=keys):
        return _rounded(x.stay_spread(t.admissions, t.icustays, keys))
