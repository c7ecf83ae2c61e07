"""The table of cases: written once, the rows of its view, dealt out in bounded tasks."""

from pyspark.sql import functions as F

from wardlens import session
from wardlens.catalog.bindings import VIEWS, Tables
from wardlens.plans import passes as ps


def hospital(spark, folder):
    """Tables with missing, repeated and unmatched keys."""
    lines = [(1, 10, 1), (1, 11, 2), (1, 10, 3), (1, 11, 4), (1, 12, 5), (1, 10, 1), (2, 12, 2), (3, 10, 1), (None, 10, 1), (4, None, 2), (5, 99, 1), (6, 13, None), *[(2, 12, 2)] * 200]
    parts = [(10, "b", "Brand#1", "X"), (10, "a", "Brand#2", "Y"), (11, "c", None, "X"), (12, None, "Brand#3", None), (13, "d", "", ""), (None, "e", "E", "E")]
    orders = [(1,), (1,), (2,), (4,), (5,), (6,), (7,), (None,)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": (orders, "o_orderkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def rows(df):
    return sorted(map(str, df.collect()))


def test_cases_are_the_rows_of_their_view(spark, tmp_path, monkeypatch):
    t = hospital(spark, tmp_path)
    expected = rows(spark.sql(VIEWS["cases"], lineitem=t.lineitem, orders=t.orders, part=t.part))
    assert len(expected) == 3 and rows(t.cases) == expected
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    assert rows(Tables(spark, str(tmp_path)).cases) == expected


def test_answers_start_from_written_cases(spark, tmp_path):
    t = hospital(spark, tmp_path)
    assert t.cases.inputFiles() == t.answers.inputFiles()
    assert not any("lineitem" in f or "part.parquet" in f for f in t.answers.inputFiles())


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    df = spark.range(1000).withColumn("text", F.lit("x"))
    out = session.dealt(df, "id")
    assert out.rdd.getNumPartitions() == 100 and rows(out) == rows(df)
    assert session.dealt(spark.range(10), "id").rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()


def test_prompts_on_record_are_sorted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    log = ps.Transcript()
    asked = spark.range(1000).select(F.col("id").alias("case_id"), F.lit("p").alias("prompt"), F.lit(None).cast("string").alias("system"))
    seen = []
    monkeypatch.setattr(ps, "cut_lineage", lambda df: seen.append(df) or session.cut_lineage(df))
    log.of("one", lambda x: x.select("case_id", F.lit("a").alias("answer")))(asked).collect()
    assert "RepartitionByExpression" in seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert log.table().where("answer = 'a' AND prompt = 'p'").count() == 1000
