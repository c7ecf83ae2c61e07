"""Hospital-shaped views over the test tables.

One text serves Spark and DuckDB, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.session import cut_lineage, dealt

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CASE_COLUMNS = """
        SELECT o_orderkey AS case_id, min(p_name) AS disease,
               max(CASE WHEN l_linenumber = 1 THEN concat(' ', p_type) END) AS symptom_1,
               max(CASE WHEN l_linenumber = 2 THEN p_brand END) AS symptom_2,
               max(CASE WHEN l_linenumber = 3 THEN '' ELSE NULL END) AS symptom_3,
               max(CASE WHEN l_linenumber = 4 THEN concat(p_brand, ' ') END) AS symptom_4,
               max(CASE WHEN l_linenumber = 5 THEN p_type END) AS symptom_5
        """

VIEWS: dict[str, str] = {
    "patients": """
        SELECT c_custkey AS subject_id,
               CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CAST('1990-01-01 00:00:00' AS {ntz})
                 - INTERVAL '1' DAY * CAST(c_custkey * 37 % 30000 AS INT)
                 - INTERVAL '1' YEAR * (CASE WHEN c_custkey % 50 = 0 THEN 300 ELSE 0 END) AS dob
        FROM {customer}""",
    "admissions": """
        SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
               o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 20 AS INT) AS dischtime,
               o_orderpriority AS ethnicity, o_orderpriority AS insurance,
               o_orderstatus AS discharge_location, o_orderstatus AS admission_type,
               CASE o_orderkey % 5 WHEN 0 THEN 'SEPSIS;PNEUMONIA' WHEN 1 THEN 'UROSEPSIS'
                    WHEN 2 THEN NULL WHEN 3 THEN 'possible sepsis' ELSE 'FEVER' END AS diagnosis,
               CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM {orders}""",
    "diagnoses": """
        SELECT l_orderkey AS hadm_id, o_custkey AS subject_id, l_linenumber AS seq_num,
               CAST(5800 + l_partkey % 200 AS STRING) AS icd9_code
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "d_codes": """
        SELECT DISTINCT CAST(5800 + l_partkey % 200 AS STRING) AS icd9_code,
               concat('TITLE_', CAST((5800 + l_partkey % 200) % 150 AS STRING)) AS short_title,
               concat('LONG_', CAST(5800 + l_partkey % 200 AS STRING)) AS long_title
        FROM {lineitem}""",
    "prescriptions": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, p_name AS drug,
               CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'n/a'
                    ELSE concat(CAST(p_size AS STRING), '.5 mg') END AS dose_val_rx
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "icustays": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey * 10 AS icustay_id,
               concat('UNIT_', CAST(o_orderkey % 6 AS STRING)) AS first_careunit,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS intime,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + o_orderkey % 97 AS INT) AS outtime,
               CAST(o_orderkey % 97 AS DOUBLE) / 10 AS los
        FROM {orders} WHERE o_orderstatus <> 'P'""",
    "labevents": """
        SELECT o_custkey AS subject_id,
               CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_orderkey END AS hadm_id,
               l_suppkey % 20 AS itemid, l_shipdate AS charttime,
               CASE WHEN l_partkey % 31 = 0 THEN 'ERROR' WHEN l_partkey % 37 = 0 THEN NULL
                    ELSE CAST(l_quantity AS STRING) END AS value,
               CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_quantity / 20 END AS valuenum,
               CASE WHEN l_returnflag = 'R' THEN 'abnormal' ELSE NULL END AS flag
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "ward_labs": """
        SELECT l_orderkey - l_orderkey % 10 AS hadm_id, l_suppkey % 20 AS itemid,
               CASE WHEN l_partkey % 31 = 0 THEN 'ERROR' WHEN l_partkey % 37 = 0 THEN NULL
                    ELSE CAST(l_quantity AS STRING) END AS value
        FROM {lineitem}""",
    "d_labitems": """
        SELECT DISTINCT l_suppkey % 20 AS itemid,
               CASE WHEN l_suppkey % 20 IN (3, 12) THEN 'Creatinine'
                    ELSE concat('LAB_', CAST(l_suppkey % 20 AS STRING)) END AS label
        FROM {lineitem}""",
    "procedures": """
        SELECT o_custkey AS subject_id, CAST(l_suppkey AS STRING) AS icd9_code
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "d_procedures": """
        SELECT CAST(s_suppkey AS STRING) AS icd9_code, s_name AS short_title FROM {supplier}""",
    "stay_admissions": """
        SELECT event_id AS hadm_id, user_id AS subject_id, ts AS admittime,
               ts + INTERVAL '1' HOUR * CAST(event_id % 90 AS INT) AS dischtime,
               CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM {events} WHERE event_type = 'signup'""",
    "stays": """
        SELECT event_id * 10 AS icustay_id, event_id AS hadm_id, user_id AS subject_id, ts AS intime,
               CASE WHEN event_id % 41 = 0 THEN NULL
                    ELSE ts + INTERVAL '1' HOUR * CAST(event_id % 72 AS INT) END AS outtime,
               CAST(event_id % 72 AS DOUBLE) / 24 AS los
        FROM {events} WHERE event_type = 'signup'""",
    "measures": """
        SELECT event_id AS row_id, user_id AS subject_id, ts AS charttime,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS valuenum
        FROM {events} WHERE event_type IN ('purchase', 'click')""",
    "outputs": """
        SELECT event_id AS row_id, user_id AS subject_id, ts AS charttime, value
        FROM {events} WHERE event_type IN ('view', 'error')""",
    "noteevents": """
        SELECT doc_id AS row_id, doc_id - doc_id % 3 AS hadm_id, lang AS category,
               CASE WHEN doc_id % 10 = 0 THEN NULL
                    ELSE CAST('1996-01-01 00:00:00' AS {ntz})
                         + INTERVAL '1' DAY * CAST(doc_id * 13 % 400 AS INT) END AS charttime,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS text
        FROM {documents}""",
    "vectors": """
        SELECT vec_id, label AS category, embedding AS vector FROM {embeddings}""",
    "scored": """
        SELECT d.doc_id AS case_id, l.quality AS label,
               CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS p_net,
               CAST(d.doc_id * 104729 % 500 + l.quality * 300 AS DOUBLE) / 1000 AS p_forest
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "cases": CASE_COLUMNS + """FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
        GROUP BY o_orderkey""",
    "severities": """
        SELECT p_brand AS symptom, min(p_size % 7) + 1 AS weight FROM {part}
        WHERE p_brand <> 'Brand#7' GROUP BY p_brand
        UNION ALL
        SELECT p_type AS symptom, min(p_size % 7) + 3 AS weight FROM {part} GROUP BY p_type""",
    "precautions": """
        SELECT p_partkey AS row_id, p_name AS disease, p_type AS precaution_1,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS precaution_2,
               CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('rest ', CAST(p_size AS STRING)) END AS precaution_3,
               CAST(NULL AS STRING) AS precaution_4
        FROM {part}""",
    "category_members": """
        SELECT p_type AS category, min(p_partkey) AS pos, p_name AS disease
        FROM {part} WHERE p_name NOT LIKE '% ring' GROUP BY p_type, p_name""",
    "answers": """
        SELECT case_id, disease,
               CASE case_id % 5 WHEN 0 THEN concat('The disease is ', disease, '. Because of the signs.')
                    WHEN 1 THEN concat('disease: ', upper(disease)) WHEN 2 THEN 'ERROR' WHEN 3 THEN disease
                    ELSE concat('The patient has Disease: ', disease, '.') END AS direct,
               CASE WHEN case_id % 4 = 0 THEN 'No idea' WHEN case_id % 4 = 1 THEN concat('So the diagnosis is ', disease)
                    ELSE concat('Fever. The most likely disease is: ', disease, '. The DIAGNOSIS IS: ', disease, '!') END AS chain,
               CASE WHEN case_id % 3 = 0 THEN 'small ring' ELSE concat(disease, ' ') END AS few_shot,
               CASE case_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN concat('POTENTIAL DISEASES:', chr(10), '1. ', disease)
                    WHEN 2 THEN NULL
                    ELSE concat('POTENTIAL DISEASES:', chr(10), '1. red widget (old)', chr(10), '2.  ', disease, chr(10),
                                'x 3. no', chr(10), '10. small ring') END AS listed,
               CASE WHEN case_id % 7 = 0 THEN 'no order' ELSE concat('RANKING:', chr(10), '1. ', disease, chr(10), '2. red widget') END AS ranking,
               concat('DISEASE: ', disease, chr(10), 'REASONING: x', chr(10), 'CONFIDENCE: ', CAST(40 + case_id % 60 AS STRING), '%',
                      chr(10), 'DISEASE: small ring', chr(10), 'confidence 70%') AS confidence,
               CASE WHEN case_id % 4 = 0 THEN 'unclear' ELSE concat('Severity: ', CAST(case_id % 11 AS STRING), '/10') END AS severity,
               CASE case_id % 4 WHEN 0 THEN 'Heart' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'PROMO' ELSE 'Other' END AS category
        FROM {cases}""",
    "turns": """
        SELECT conv_id * 1000 + turn AS turn_id, conv_id, turn, role, text FROM {conversations}""",
}


class Tables:
    """Base tables and views of one scale-factor folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "cases":
            return dealt(self._cases, "case_id")
        if name not in VIEWS:
            raise AttributeError(name)
        used = {t: getattr(self, t) for t in _inputs(name)}
        return self.spark.sql(VIEWS[name].replace("{ntz}", "TIMESTAMP_NTZ"), **used)

    @cached_property
    def _cases(self) -> DataFrame:
        """The view ``cases``, written once for all uses by one query; a view on top of it starts from these rows.

        Lines meet their parts first, unsorted; then all lines of an order meet in one task, where the join that
        leaves out lines without an order and the aggregate share one shuffle and one sort. An order with the same
        key again would only repeat lines, which changes no least or greatest value. A case has several lines, and
        they are short: sixteen of them count as a row of a task.
        """
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
        parts = self.part.select("p_partkey", "p_name", "p_brand", "p_type").hint("shuffle_hash")
        named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
        known = self.orders.select(F.col("o_orderkey").alias("_known"))
        kept = dealt(named, "l_orderkey", lines.count() // 16).join(known, F.col("l_orderkey") == F.col("_known"), "left_semi")
        lines_of = kept.withColumnRenamed("l_orderkey", "o_orderkey")
        return cut_lineage(self.spark.sql(CASE_COLUMNS + "FROM {lines} GROUP BY o_orderkey", lines=lines_of))


def _inputs(view: str) -> list[str]:
    return [t for t in re.findall(r"{(\w+)}", VIEWS[view]) if t != "ntz"]


def with_views(body: str) -> str:
    """Prefix a DuckDB statement with the views its text names, and the views those name."""
    named = {v for v in VIEWS if re.search(rf"\b{v}\b", body)}
    named |= {t for v in named for t in _inputs(v) if t in VIEWS}
    if not named:
        return body
    ctes = []
    for v in (v for v in VIEWS if v in named):
        text = VIEWS[v].replace("{ntz}", "TIMESTAMP")
        ctes.append(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', text)})")
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ", ".join(ctes) + ", " + body[4:].lstrip()
    return "WITH " + ", ".join(ctes) + " " + body
