import pytest
from pyspark.sql import functions as F

from wardlens.functions import scalars as sc
from wardlens.plans import evaluation as e


def scored(table, *rows):
    return table("y int, p double", list(rows))


@pytest.mark.parametrize(
    "data, auc",
    [
        ([(1, 0.5), (0, 0.5), (1, 0.5)], 0.5),
        ([(1, 0.2), (1, 0.9)], None),
        ([(1, 0.9), (0, 0.1), (0, 0.3)], 1.0),
        ([(1, 0.1), (0, 0.9)], 0.0),
        ([(1, 0.4), (0, 0.4), (1, 0.8), (0, 0.1)], 0.875),
    ],
)
def test_auc(table, data, auc):
    assert e.roc_auc(scored(table, *data), "y", "p").collect()[0]["auc"] == auc


def test_auc_equals_spark_evaluator(spark, table):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(2000).select(
        (F.xxhash64("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)) / 97.0).alias("p")
    )
    ours = e.roc_auc(df, "y", "p").collect()[0]["auc"]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_curve_drops_points_on_a_line(table, rows):
    df = scored(table, (1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4))
    full = rows(e.roc_curve(df, "y", "p", drop_collinear=False), "threshold")
    bent = rows(e.roc_curve(df, "y", "p"), "threshold")
    assert len(full) == 7
    assert bent == [(0.4,), (0.5,), (0.7,), (0.9,), (None,)]


def test_buckets_and_actions(table, rows):
    df = table("p double", [(v,) for v in (0.0, 0.2, 0.3, 0.6, 0.9999, 1.0)])
    out = df.select("p", sc.risk_bucket("p"), e.action("p"), e.demo_action("p"), e.demo_category("p"))
    assert rows(out) == [
        (0.0, "Very Low", "Standard Care", "Standard Care", "Low"),
        (0.2, "Low", "Standard Care", "Standard Care", "Low"),
        (0.3, "Low", "Close Monitoring", "Standard Care", "Low"),
        (0.6, "High", "Immediate Intervention", "Close Monitoring", "Moderate"),
        (0.9999, "Very High", "Immediate Intervention", "Immediate Intervention", "High"),
        (1.0, None, "Immediate Intervention", "Immediate Intervention", "High"),
    ]


def test_stratification_keeps_empty_buckets(table, rows):
    out = e.risk_stratification(scored(table, (1, 0.1), (0, 0.15), (1, 1.0)), "y", "p")
    assert [(r.risk, r.cases, r.rate_percent) for r in sorted(out.collect())] == [
        ("Very Low", 2, 50.0), ("Low", 0, 0.0), ("Moderate", 0, 0.0), ("High", 0, 0.0), ("Very High", 0, 0.0)
    ]


def test_report_with_zero_divisor(table):
    out = {r["class"]: r for r in e.classification_report(scored(table, (1, 0.1), (0, 0.2)), "y", e.predicted("p")).collect()}
    assert out["1"]["precision"] == 0.0 and out["1"]["recall"] == 0.0 and out["0"]["precision"] == 0.5
    assert out["accuracy"]["f1"] == 0.5 and out["weighted avg"]["support"] == 2


def test_calibration_bins_are_right_closed(table, rows):
    out = e.calibration_curve(scored(table, (1, 0.0), (0, 0.1), (1, 0.10001), (1, 1.0)), "y", "p")
    assert rows(out, "bin", "n") == [(0, 2), (1, 1), (9, 1)]


def test_clinical_score(table, rows):
    df = table("age int, a double, b double, c double", [(81, 10.0, 31.0, 94.0), (66, 12.0, 25.0, 100.0), (36, None, 25.0, 100.0), (30, 12.0, 25.0, 100.0)])
    score = e.clinical_score("age", ["a", "b", "c"])
    assert rows(df.select("age", score, e.clinical_category(score))) == [
        (30, 0, "Very Low"), (36, 1, "Low"), (66, 3, "Moderate"), (81, 7, "Very High")
    ]


def test_error_table_fills_absent_categories(table, rows):
    df = table("y int, a double, b double", [(1, 0.9, 0.9), (0, 0.9, 0.9)])
    assert rows(e.error_table(df, "y", "a", "b")) == [
        ("Both Models Correct", 1, 50.0), ("Both Models Wrong", 1, 50.0), ("Only DL Correct", 0, 0.0), ("Only RF Correct", 0, 0.0)
    ]


def test_lab_flags_without_a_range(table, rows):
    labs = table("itemid long, valuenum double", [(1, 5.0), (1, 50.0), (1, None), (2, 5.0)])
    ranges = table("itemid long, lo double, hi double", [(1, 10.0, 60.0)])
    assert rows(e.lab_flags(labs, ranges), "itemid", "valuenum", "abnormal") == [
        (1, 5.0, True), (1, 50.0, False), (1, None, False), (2, 5.0, False)
    ]


def test_auc_of_billions_of_rows_does_not_overflow(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wardlens.plans import evaluation as e

    weighed = spark.createDataFrame([(0.1, 0, 4_000_000_000), (0.9, 4_000_000_000, 0)], "threshold double, pos long, neg long")
    monkeypatch.setattr(e, "_by_score", lambda df, label, score: weighed)
    row = e.roc_auc(spark.range(1).select(F.lit(1).alias("y"), F.lit(0.5).alias("p")), "y", "p").first()
    assert (row.auc, row.positives) == (1.0, 4_000_000_000)
