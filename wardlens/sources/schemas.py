"""Declared schemas of the input tables, so that no file is read twice to guess types."""

SCHEMAS: dict[str, str] = {
    "patients": "subject_id long, gender string, dob timestamp_ntz",
    "admissions": (
        "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
        "hospital_expire_flag int, ethnicity string, discharge_location string, insurance string, "
        "admission_type string, diagnosis string"
    ),
    "icustays": (
        "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz, outtime timestamp_ntz, "
        "los double, first_careunit string"
    ),
    "diagnoses": "row_id long, subject_id long, hadm_id long, seq_num int, icd9_code string",
    "d_codes": "icd9_code string, short_title string, long_title string",
    "procedures": "subject_id long, icd9_code string",
    "d_procedures": "icd9_code string, short_title string",
    "prescriptions": "subject_id long, hadm_id long, drug string, dose_val_rx string",
    "labevents": (
        "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, value string, "
        "valuenum double, flag string"
    ),
    "d_labitems": "itemid long, label string",
    "outputevents": "subject_id long, itemid long, charttime timestamp_ntz, value double",
    "noteevents": "row_id long, hadm_id long, charttime timestamp_ntz, category string, text string",
    "symptom_cases": "disease string, " + ", ".join(f"symptom_{i} string" for i in range(1, 18)),
    "severities": "symptom string, weight int",
    "precautions": "disease string, " + ", ".join(f"precaution_{i} string" for i in range(1, 5)),
}
