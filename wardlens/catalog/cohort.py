"""Cohort reports CQ-1 to CQ-23."""

from __future__ import annotations

from wardlens.catalog import query
from wardlens.plans import cohort as c

COHORT = "SELECT hadm_id FROM diagnoses WHERE icd9_code LIKE '584%'"
SUBJECTS = f"SELECT subject_id FROM admissions WHERE hadm_id IN ({COHORT})"
READMITTED = f"""
    SELECT *, date_diff('day', dischtime, next_admittime) AS days_until_next
    FROM (SELECT subject_id, hadm_id, admittime, dischtime,
                 lead(admittime) OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS next_admittime
          FROM admissions WHERE hadm_id IN ({COHORT}))"""


@query(
    "cq01_cases_by_code",
    """SELECT d.icd9_code, short_title, long_title, count(*) AS total_cases
       FROM diagnoses d JOIN d_codes t ON d.icd9_code = t.icd9_code
       WHERE d.icd9_code LIKE '584%' AND seq_num = 1 GROUP BY ALL""",
)
def _(t):
    return c.cases_by_code(t.diagnoses, t.d_codes)


COMORBID = """
    FROM diagnoses a JOIN diagnoses b ON a.subject_id = b.subject_id AND a.hadm_id = b.hadm_id
    JOIN d_codes ta ON ta.icd9_code = a.icd9_code JOIN d_codes tb ON tb.icd9_code = b.icd9_code
    WHERE a.icd9_code LIKE '584%' AND a.seq_num = 1 AND b.icd9_code NOT LIKE '584%'"""


@query(
    "cq02_comorbidities",
    f"""SELECT tb.short_title, count(*) AS comorbidity_count {COMORBID}
        GROUP BY tb.short_title, b.icd9_code HAVING count(*) > 10""",
)
def _(t):
    return c.comorbidities(t.diagnoses, t.d_codes, more_than=10)


@query(
    "cq03_comorbidities_by_index",
    f"""SELECT ta.short_title AS index_diagnosis, tb.short_title AS comorbidity_diagnosis,
               count(*) AS comorbidity_count {COMORBID}
        GROUP BY ta.short_title, tb.short_title, b.icd9_code HAVING count(*) > 2""",
)
def _(t):
    return c.comorbidities_by_index(t.diagnoses, t.d_codes, more_than=2)


@query(
    "cq04_second_position_comorbidities",
    f"""SELECT tb.short_title, count(*) AS comorbidity_count {COMORBID} AND b.seq_num = 2
        GROUP BY tb.short_title, b.icd9_code""",
)
def _(t):
    return c.comorbidities(t.diagnoses, t.d_codes, position=2)


@query(
    "cq05_share_by_ethnicity",
    """SELECT a.ethnicity, count(*) AS cases, max(g.n) AS all_admissions,
              ceil(count(*) / max(g.n)::DOUBLE * 100) AS percentage
       FROM diagnoses d JOIN admissions a ON a.subject_id = d.subject_id
       JOIN (SELECT ethnicity, count(*) AS n FROM admissions GROUP BY 1) g ON g.ethnicity = a.ethnicity
       WHERE d.icd9_code LIKE '584%' AND seq_num = 1 AND g.n > 500 GROUP BY a.ethnicity""",
)
def _(t):
    return c.share_by_ethnicity(t.diagnoses, t.admissions)


@query(
    "cq05_share_by_ethnicity_dedup",
    """SELECT a.ethnicity, count(*) AS cases, max(g.n) AS all_admissions,
              ceil(count(*) / max(g.n)::DOUBLE * 100) AS percentage
       FROM admissions a
       JOIN (SELECT ethnicity, count(*) AS n FROM admissions GROUP BY 1) g ON g.ethnicity = a.ethnicity
       WHERE a.subject_id IN (SELECT subject_id FROM diagnoses WHERE icd9_code LIKE '584%' AND seq_num = 1)
         AND g.n > 500 GROUP BY a.ethnicity""",
)
def _(t):
    return c.share_by_ethnicity(t.diagnoses, t.admissions, dedup=True)


@query(
    "cq06_readmissions",
    f"""SELECT *, CASE WHEN days_until_next <= 60 THEN 'YES' ELSE 'NO' END AS readmitted_within_60_days,
               CASE WHEN days_until_next <= 30 THEN 'YES' ELSE 'NO' END AS readmitted_within_30_days,
               CASE WHEN days_until_next <= 7 THEN 'YES' ELSE 'NO' END AS readmitted_within_7_days
        FROM ({READMITTED})""",
)
def _(t):
    return c.readmissions(t.diagnoses, t.admissions)


def _rate(days: int) -> str:
    return f"""
        SELECT count(*) AS total_admissions, count(*) FILTER (WHERE days_until_next <= {days}) AS readmissions,
               ceil(count(*) FILTER (WHERE days_until_next <= {days}) / nullif(count(*), 0)::DOUBLE * 100)
                 AS readmission_rate_percent
        FROM ({READMITTED})"""


for number, limit in ((8, 7), (9, 30), (10, 60)):

    @query(f"cq{number:02d}_readmission_rate_{limit}d", _rate(limit))
    def _(t, limit=limit):
        return c.readmission_rate(c.readmissions(t.diagnoses, t.admissions, ordered=False), limit)


@query(
    "cq11_readmission_by_stay_length",
    f"""SELECT date_diff('day', admittime, dischtime)::INT AS length_of_stay, count(*) AS total_admissions,
               count(*) FILTER (WHERE days_until_next <= 30) AS readmissions,
               ceil(count(*) FILTER (WHERE days_until_next <= 30) / count(*)::DOUBLE * 100)
                 AS readmission_rate_percent
        FROM ({READMITTED}) GROUP BY 1""",
)
def _(t):
    return c.readmission_by_stay_length(c.readmissions(t.diagnoses, t.admissions, ordered=False))


@query(
    "cq12_drugs_by_admissions",
    f"""SELECT drug, count(DISTINCT hadm_id) AS prescriptions_count FROM prescriptions
        WHERE hadm_id IN ({COHORT}) GROUP BY drug""",
)
def _(t):
    return c.drugs_by_admissions(t.diagnoses, t.prescriptions)


@query(
    "cq13_cases_by_age_gender",
    """SELECT gender, CASE WHEN d10 = 300 THEN 90 WHEN d10 > 300 THEN 95 ELSE d10 END AS age_group,
              count(*) AS admissions
       FROM (SELECT gender, (floor((year(admittime) - year(dob)) / 10.0) * 10)::BIGINT AS d10
             FROM patients p JOIN admissions a ON p.subject_id = a.subject_id
             JOIN diagnoses d ON a.hadm_id = d.hadm_id WHERE icd9_code LIKE '584%' AND seq_num = 1)
       GROUP BY 1, 2""",
)
def _(t):
    return c.cases_by_age_gender(t.diagnoses, t.admissions, t.patients)


@query(
    "cq14_mortality_by_stay_length",
    """SELECT date_diff('day', admittime, dischtime)::INT AS length_of_stay, count(*) AS total_admissions,
              sum(hospital_expire_flag)::BIGINT AS mortality_count,
              ceil(sum(hospital_expire_flag) / count(*)::DOUBLE * 100) AS mortality_rate_percent
       FROM admissions a JOIN diagnoses d ON a.hadm_id = d.hadm_id WHERE icd9_code LIKE '584%' GROUP BY 1""",
)
def _(t):
    return c.mortality_by_stay_length(t.diagnoses, t.admissions)


@query(
    "cq14_mortality_by_stay_length_dedup",
    f"""SELECT date_diff('day', admittime, dischtime)::INT AS length_of_stay, count(*) AS total_admissions,
               sum(hospital_expire_flag)::BIGINT AS mortality_count,
               ceil(sum(hospital_expire_flag) / count(*)::DOUBLE * 100) AS mortality_rate_percent
        FROM admissions WHERE hadm_id IN ({COHORT}) GROUP BY 1""",
)
def _(t):
    return c.mortality_by_stay_length(t.diagnoses, t.admissions, dedup=True)


@query(
    "cq15_abnormal_labs",
    f"""SELECT l.itemid, label, count(*) AS abnormal_count
        FROM labevents l JOIN d_labitems i ON l.itemid = i.itemid
        WHERE flag = 'abnormal' AND subject_id IN ({SUBJECTS})
        GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
)
def _(t):
    return c.abnormal_labs(t.diagnoses, t.admissions, t.labevents, t.d_labitems)


@query(
    "cq16_patients_by_unit",
    f"""SELECT first_careunit, count(DISTINCT subject_id) AS patient_count FROM icustays
        WHERE subject_id IN ({SUBJECTS}) GROUP BY 1""",
)
def _(t):
    return c.patients_by_unit(t.diagnoses, t.admissions, t.icustays)


@query(
    "cq17_drug_doses",
    f"""SELECT drug, avg(nullif(regexp_extract(dose_val_rx, '[0-9]+'), '')::DOUBLE) AS avg_dose,
               count(*) AS prescription_count
        FROM prescriptions WHERE dose_val_rx IS NOT NULL AND subject_id IN ({SUBJECTS})
        GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
)
def _(t):
    return c.drug_doses(t.diagnoses, t.admissions, t.prescriptions)


@query(
    "cq18_cases_by_year",
    """SELECT year(admittime)::INT AS admission_year, count(*) AS admission_count
       FROM diagnoses d JOIN admissions a ON d.hadm_id = a.hadm_id WHERE icd9_code LIKE '584%' GROUP BY 1""",
)
def _(t):
    return c.cases_by_year(t.diagnoses, t.admissions)


@query(
    "cq19_mortality_by_unit",
    f"""SELECT first_careunit, count(DISTINCT a.subject_id) AS total_patients,
               count(*) FILTER (WHERE hospital_expire_flag = 1) AS deceased_count,
               round(count(*) FILTER (WHERE hospital_expire_flag = 1)
                     / count(DISTINCT a.subject_id)::DOUBLE * 100, 2) AS mortality_rate
        FROM admissions a JOIN icustays i ON a.hadm_id = i.hadm_id
        WHERE a.subject_id IN ({SUBJECTS}) GROUP BY 1""",
)
def _(t):
    return c.mortality_by_unit(t.diagnoses, t.admissions, t.icustays)


@query(
    "cq19_mortality_by_unit_dedup",
    f"""SELECT first_careunit, count(DISTINCT a.subject_id) AS total_patients,
               count(DISTINCT CASE WHEN hospital_expire_flag = 1 THEN a.subject_id END) AS deceased_count,
               round(count(DISTINCT CASE WHEN hospital_expire_flag = 1 THEN a.subject_id END)
                     / count(DISTINCT a.subject_id)::DOUBLE * 100, 2) AS mortality_rate
        FROM admissions a JOIN icustays i ON a.hadm_id = i.hadm_id
        WHERE a.subject_id IN ({SUBJECTS}) GROUP BY 1""",
)
def _(t):
    return c.mortality_by_unit(t.diagnoses, t.admissions, t.icustays, dedup=True)


@query(
    "cq20_icu_stay_by_age_gender",
    f"""SELECT *, round(patient_count / (sum(patient_count) OVER ())::DOUBLE * 100, 2) AS proportion_percent
        FROM (SELECT gender, CASE WHEN d10 = 300 THEN '90+' WHEN d10 > 300 THEN '95+'
                                  ELSE concat(d10::VARCHAR, 's') END AS age_group,
                     count(*) AS patient_count, round(avg(los), 2) AS avg_icu_los_days
              FROM (SELECT gender, los, (floor((year(intime) - year(dob)) / 10.0) * 10)::BIGINT AS d10
                    FROM patients p JOIN icustays i ON p.subject_id = i.subject_id
                    WHERE p.subject_id IN ({SUBJECTS}))
              GROUP BY 1, 2)""",
)
def _(t):
    return c.icu_stay_by_age_gender(t.diagnoses, t.admissions, t.patients, t.icustays)


@query(
    "cq21_procedures",
    f"""SELECT p.icd9_code, short_title, count(*) AS procedure_count
        FROM procedures p JOIN d_procedures x ON p.icd9_code = x.icd9_code
        WHERE subject_id IN ({SUBJECTS}) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
)
def _(t):
    return c.procedures_top(t.diagnoses, t.admissions, t.procedures, t.d_procedures)


@query(
    "cq22_discharge_locations",
    f"""SELECT discharge_location, count(*) AS discharge_count FROM admissions
        WHERE subject_id IN ({SUBJECTS}) GROUP BY 1""",
)
def _(t):
    return c.discharge_locations(t.diagnoses, t.admissions)


def _by_creatinine(rows: str) -> str:
    return f"""
        SELECT CASE WHEN peak < 1.2 THEN 'Normal' WHEN peak BETWEEN 1.2 AND 2.0 THEN 'Mildly Elevated'
                    ELSE 'Severely Elevated' END AS creatinine_level,
               count(*) AS patient_count, sum(hospital_expire_flag)::BIGINT AS deceased_count,
               round(sum(hospital_expire_flag) / count(*)::DOUBLE * 100, 2) AS mortality_rate
        FROM (SELECT subject_id, max(valuenum) AS peak FROM labevents l JOIN d_labitems i ON l.itemid = i.itemid
              WHERE label = 'Creatinine' GROUP BY 1) k
        JOIN ({rows}) m ON k.subject_id = m.subject_id GROUP BY 1"""


@query(
    "cq23_mortality_by_creatinine",
    _by_creatinine(
        """SELECT a.subject_id, hospital_expire_flag FROM diagnoses d
           JOIN admissions a ON d.hadm_id = a.hadm_id WHERE icd9_code LIKE '584%'"""
    ),
)
def _(t):
    return c.mortality_by_creatinine(t.diagnoses, t.admissions, t.labevents, t.d_labitems)


@query(
    "cq23_mortality_by_creatinine_dedup",
    _by_creatinine(f"SELECT subject_id, hospital_expire_flag FROM admissions WHERE hadm_id IN ({COHORT})"),
)
def _(t):
    return c.mortality_by_creatinine(t.diagnoses, t.admissions, t.labevents, t.d_labitems, dedup=True)
