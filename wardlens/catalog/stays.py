"""Event-time features TS-1 to TS-11."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.plans import stays as s

TIMELINE = """
    SELECT p.subject_id, gender, dob, a.hadm_id, admittime, dischtime, hospital_expire_flag, icustay_id,
           intime, outtime, los,
           (year(admittime) - year(dob) - CASE WHEN (month(admittime), day(admittime)) < (month(dob), day(dob))
                                              THEN 1 ELSE 0 END)::INT AS age
    FROM patients p JOIN {adm} a ON p.subject_id = a.subject_id
    JOIN {icu} i ON i.subject_id = a.subject_id AND i.hadm_id = a.hadm_id
    WHERE year(dob) > 1800 AND year(admittime) > 2000 AND admittime > dob AND age BETWEEN 18 AND 100"""


@query("ts01_timeline", TIMELINE.format(adm="admissions", icu="icustays"))
def _(t):
    return s.timeline(t.patients, t.admissions, t.icustays)


CHANGES = """
    SELECT icustay_id, subject_id, baseline, peak, num_measurements,
           CASE WHEN baseline > 0 THEN (peak - baseline) / baseline * 100 ELSE 0 END AS pct_increase,
           peak - baseline AS abs_increase
    FROM (SELECT icustay_id, s.subject_id, max(valuenum) AS peak, count(*) AS num_measurements,
                 max(valuenum) FILTER (WHERE rn = 1) AS baseline
          FROM (SELECT s.icustay_id, s.subject_id, valuenum,
                       row_number() OVER (PARTITION BY s.icustay_id ORDER BY charttime, row_id) AS rn
                FROM stays s JOIN measures m ON s.subject_id = m.subject_id
                  AND charttime >= intime AND charttime <= outtime) s GROUP BY 1, 2)"""
TOTALS = """
    SELECT icustay_id, subject_id, total_output,
           CASE WHEN h > 0 THEN total_output * (24.0 / h) ELSE 0 END AS output_per_24h
    FROM (SELECT icustay_id, s.subject_id, date_diff('microsecond', any_value(intime), any_value(outtime)) / 3.6e9 AS h,
                 coalesce(sum(value), 0) AS total_output
          FROM stays s JOIN outputs o ON s.subject_id = o.subject_id
            AND charttime >= intime AND charttime <= outtime GROUP BY 1, 2)"""
LABELLED = f"""
    SELECT coalesce(c.icustay_id, o.icustay_id) AS icustay_id, coalesce(c.subject_id, o.subject_id) AS subject_id,
           baseline, peak, num_measurements, pct_increase, abs_increase, total_output, output_per_24h,
           CASE WHEN coalesce(pct_increase >= 50, FALSE) OR coalesce(abs_increase >= 0.3, FALSE)
                  OR coalesce(output_per_24h < 500, FALSE) THEN 1 ELSE 0 END AS label
    FROM ({CHANGES}) c FULL JOIN ({TOTALS}) o ON c.icustay_id = o.icustay_id"""


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(
    "ts02_measure_changes",
    f"""SELECT icustay_id, subject_id, baseline, peak, num_measurements, round(pct_increase, 6) AS pct_increase,
               round(abs_increase, 6) AS abs_increase FROM ({CHANGES})""",
)
def _(t):
    return _rounded(s.measure_changes(t.stays, t.measures), "pct_increase", "abs_increase")


@query(
    "ts03_output_totals",
    f"""SELECT icustay_id, subject_id, round(total_output, 6) AS total_output,
               round(output_per_24h, 6) AS output_per_24h FROM ({TOTALS})""",
)
def _(t):
    return _rounded(s.output_totals(t.stays, t.outputs), "total_output", "output_per_24h")


def labelled(t):
    return s.label_stays(s.measure_changes(t.stays, t.measures), s.output_totals(t.stays, t.outputs))


FIGURES = ("pct_increase", "abs_increase", "total_output", "output_per_24h")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FIGURES)


@query(
    "ts04_label_stays",
    f"""SELECT icustay_id, subject_id, baseline, peak, num_measurements, {ROUNDED}, label FROM ({LABELLED})""",
)
def _(t):
    return _rounded(labelled(t), *FIGURES)


@query(
    "ts04_prevalence",
    f"SELECT count(*) AS stays, round(avg(label) * 100, 6) AS prevalence_percent FROM ({LABELLED})",
)
def _(t):
    return _rounded(s.prevalence(labelled(t)), "prevalence_percent")


MODEL_FRAME = f"""
    SELECT icustay_id, age, CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS gender_f, los, baseline, peak,
           pct_increase, abs_increase, num_measurements, total_output, output_per_24h, hospital_expire_flag, label
    FROM ({TIMELINE.format(adm="stay_admissions", icu="stays")}) JOIN ({LABELLED}) l USING (icustay_id, subject_id)"""


def model_frame(t):
    return s.model_frame(s.timeline(t.patients, t.stay_admissions, t.stays), labelled(t))


@query(
    "ts04_model_frame",
    f"""SELECT * REPLACE (round(los, 6) AS los, {ROUNDED}) FROM ({MODEL_FRAME})""",
)
def _(t):
    return _rounded(model_frame(t), "los", *FIGURES)


@query(
    "ts05_time_grid",
    """SELECT icustay_id, step::INT AS step, (step * 4)::INT AS hours_since_start
       FROM stays, range(0, 12) g(step)""",
)
def _(t):
    return s.time_grid(t.stays)


MEANS = """
    SELECT s.icustay_id, g.step::INT AS step, avg(valuenum) AS mean_value
    FROM stays s, range(0, 12) g(step), measures m
    WHERE m.subject_id = s.subject_id AND charttime >= intime AND charttime <= intime + INTERVAL 48 HOUR
      AND charttime >= intime + INTERVAL 1 HOUR * (g.step * 4 - 2)::INT
      AND charttime < intime + INTERVAL 1 HOUR * (g.step * 4 + 2)::INT GROUP BY 1, 2"""
SUMS = """
    SELECT s.icustay_id, g.step::INT AS step, coalesce(sum(value), 0) AS sum_output
    FROM stays s, range(0, 12) g(step), outputs o
    WHERE o.subject_id = s.subject_id AND charttime >= intime AND charttime <= intime + INTERVAL 48 HOUR
      AND charttime >= intime + INTERVAL 1 HOUR * (g.step * 4)::INT
      AND charttime < intime + INTERVAL 1 HOUR * (g.step * 4 + 4)::INT GROUP BY 1, 2"""


@query("ts06_grid_means", f"SELECT icustay_id, step, round(mean_value, 6) AS mean_value FROM ({MEANS})")
def _(t):
    return _rounded(s.grid_means(t.stays, t.measures), "mean_value")


@query("ts07_grid_sums", f"SELECT icustay_id, step, round(sum_output, 6) AS sum_output FROM ({SUMS})")
def _(t):
    return _rounded(s.grid_sums(t.stays, t.outputs), "sum_output")


SEQUENCES = f"""
    WITH grid AS (SELECT s.icustay_id, l.label, g.step::INT AS step, mean_value, sum_output
                  FROM stays s JOIN ({LABELLED}) l ON l.icustay_id = s.icustay_id CROSS JOIN range(0, 12) g(step)
                  LEFT JOIN ({MEANS}) a ON a.icustay_id = s.icustay_id AND a.step = g.step
                  LEFT JOIN ({SUMS}) b ON b.icustay_id = s.icustay_id AND b.step = g.step
                  WHERE s.icustay_id IN (SELECT icustay_id FROM stays s JOIN measures m ON s.subject_id = m.subject_id
                        AND charttime >= intime AND charttime <= intime + INTERVAL 48 HOUR
                        GROUP BY 1 HAVING count(*) >= 2)),
    ahead AS (SELECT icustay_id, label, step,
                     last_value(mean_value IGNORE NULLS) OVER w AS mean_value,
                     last_value(sum_output IGNORE NULLS) OVER w AS sum_output
              FROM grid WINDOW w AS (PARTITION BY icustay_id ORDER BY step)),
    seq AS (SELECT * FROM (SELECT icustay_id, label, step, (step * 4)::DOUBLE AS hours_since_start,
                     first_value(mean_value IGNORE NULLS) OVER w AS mean_value,
                     first_value(sum_output IGNORE NULLS) OVER w AS sum_output
              FROM ahead WINDOW w AS (PARTITION BY icustay_id ORDER BY step
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
            WHERE mean_value IS NOT NULL AND sum_output IS NOT NULL) """


def sequences(t):
    return s.sequences(t.stays, t.measures, t.outputs, labelled(t))


@query(
    "ts08_sequences",
    SEQUENCES
    + """SELECT icustay_id, step, round(mean_value, 6) AS mean_value, round(sum_output, 6) AS sum_output,
                hours_since_start, label FROM seq""",
)
def _(t):
    return _rounded(sequences(t), "mean_value", "sum_output")


@query(
    "ts09_cap_subjects",
    """SELECT * FROM stays WHERE subject_id IN (
         SELECT subject_id FROM (SELECT DISTINCT subject_id FROM stays)
         ORDER BY CAST('0x' || substr(md5('42:' || CAST(subject_id AS VARCHAR)), 1, 13) AS BIGINT), subject_id LIMIT 100)""",
)
def _(t):
    return s.cap_subjects(t.stays, 100)


@query(
    "ts10_scaled_sequences",
    SEQUENCES
    + ", ".join(["SELECT icustay_id, step, label"])
    + "".join(
        f""", round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ())
              / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END, 6) AS {c}"""
        for c in s.SEQUENCE_FEATURES
    )
    + " FROM seq",
)
def _(t):
    return _rounded(s.scaled_sequences(sequences(t)), *s.SEQUENCE_FEATURES)


@query(
    "ts11_sequence_summary",
    SEQUENCES
    + """SELECT count(DISTINCT icustay_id) AS stays, 12::BIGINT AS steps, 3::BIGINT AS features,
                count(*) FILTER (WHERE label = 0 AND step = 0) AS negatives,
                count(*) FILTER (WHERE label = 1 AND step = 0) AS positives,
                round(avg(label) * 100, 6) AS positive_percent FROM seq""",
)
def _(t):
    return _rounded(s.sequence_summary(sequences(t)), "positive_percent")
