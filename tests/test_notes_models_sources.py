import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.plans import features as f
from wardlens.plans import models as m
from wardlens.plans import notes as n
from wardlens.sources import readers, writers
from wardlens.sources.schemas import SCHEMAS


def vectors(spark, rows=40, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, int(i % 3 == 0), [float(x) for x in rng.normal(i % 2, 1, dims)]) for i in range(rows)]
    return spark.createDataFrame(data, "id long, g int, v array<double>"), data


def PAIRS(spark):
    return spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "group_a int, group_b int")


def test_zero_vectors_count_with_similarity_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0])], "g int, v array<double>")
    out = {(r.group_a, r.group_b): r.mean_similarity for r in n.group_similarity(df, PAIRS(spark), "g", "v", 2).collect()}
    assert out == {(0, 0): 0.25, (0, 1): 0.5, (1, 1): 1.0}


def test_group_similarity_equals_all_pairs(spark):
    df, data = vectors(spark)
    unit = {i: (g, np.array(v) / np.linalg.norm(v)) for i, g, v in data}
    out = {(r.group_a, r.group_b): r.mean_similarity for r in n.group_similarity(df, PAIRS(spark), "g", "v", 6).collect()}
    for a, b in ((0, 0), (0, 1), (1, 1)):
        pairs = [x @ y for ga, x in unit.values() if ga == a for gb, y in unit.values() if gb == b]
        assert out[(a, b)] == pytest.approx(np.mean(pairs))


def test_similarity_matrix_is_symmetric_with_unit_diagonal(spark):
    df, _ = vectors(spark)
    sims = {(r.id, r.anchor): r.similarity for r in n.similarity_to_first(df, "id", "v", 4).collect()}
    for i in range(4):
        assert sims[(i, i)] == pytest.approx(1.0)
        for j in range(4):
            assert sims[(i, j)] == pytest.approx(sims[(j, i)])


def test_projection_equals_svd(spark):
    df, data = vectors(spark)
    x = np.array([v for _, _, v in data])
    x = x - x.mean(axis=0)
    want = np.abs(x @ np.linalg.svd(x)[2].T[:, :2])
    got = np.abs(np.array([[r.pca1, r.pca2] for r in n.project(df, "v", 6).orderBy("id").collect()]))
    assert np.allclose(got, want, atol=1e-6)


def test_clusters_are_k(spark):
    df, _ = vectors(spark)
    assert n.clusters(df, "v", 3).select("cluster").distinct().count() == 3


def test_ngrams(spark, table):
    df = table("w array<string>", [(["a", "b", "c"],), (["a"],), ([],)])
    assert [r[0] for r in df.select(n.ngrams("w", 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(n.ngrams("w", 3)).collect()] == [["a b c"], [], []]


def test_notes_fan_out(table, rows):
    notes = table("row_id long, hadm_id long, text string", [(1, 1, "a"), (2, 2, "b"), (3, None, "c")])
    codes = table("hadm_id long, icd9_code string", [(1, "5849"), (1, "5841"), (1, "4010"), (2, "4010"), (2, None)])
    cohort = n.note_cohort(notes, codes, "584")
    assert rows(cohort, "row_id", "copies") == [(1, 2)]
    assert rows(n.repeated(cohort), "row_id", "copy") == [(1, 1), (1, 2)]
    assert rows(n.note_cohort(notes, codes, "584", distinct=True), "row_id", "copies") == [(1, 1)]
    both = n.labelled_notes(notes, codes, "584")
    assert rows(both, "row_id", "label", "copies") == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert rows(n.labelled_notes(notes, codes, "584", per_class=9), "row_id", "label") == [(1, 0), (1, 1), (1, 1), (2, 0)]
    assert rows(n.labelled_notes(notes, codes, "584", per_class=1), "row_id", "label") == [(1, 0), (1, 1)]


def test_entities_weighted_by_copies(table, rows):
    notes = table("row_id long, text string, copies long", [(1, "Renal failure, renal 12", 2), (2, "renal", 1), (3, None, 5)])
    terms = table("term string, label string", [("renal", "W"), ("renal failure", "P"), ("absent", "W")])
    assert rows(n.term_entities(notes, terms)) == [("renal", "W", 5), ("renal failure", "P", 2)]
    assert rows(n.pattern_entities(notes, {"NUM": r"\d+", "CAP": r"[A-Z]\w+"})) == [("12", "NUM", 2), ("Renal", "CAP", 2)]


def test_nearest_words_keep_unknown_terms(spark, table, rows):
    v = table("word string, vector array<double>", [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])])
    out = rows(n.nearest_words(v, n.terms_table(spark, ["a", "two words"]), 1), "term", "word")
    assert out == [("a", "b"), ("two words", None)]
    assert rows(n.nearest_words(v, n.terms_table(spark, ["nope"])), "term", "word") == [("nope", None)]


def test_forest_scores_and_round_trip(spark, tmp_path):
    df = spark.range(300).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 10 > 6).cast("int").alias("label")
    )
    model = m.forest(df, ["x", "z"], trees=5, depth=4, balanced=True, min_leaf=2)
    scores = m.with_probability(model, df, keep=["id", "label"])
    low, high = scores.agg(F.min("p"), F.max("p")).collect()[0]
    assert 0 <= low <= high <= 1
    importance = m.feature_importance(model, ["x", "z"], spark).collect()
    assert importance[0].feature == "x" and sum(r.importance for r in importance) == pytest.approx(1.0)
    again = writers.save_model(model, str(tmp_path / "model"))
    same = m.with_probability(again, df, "q", keep=["id"]).join(scores, "id").where("abs(p - q) > 1e-12")
    assert same.count() == 0


def test_class_weights(table, rows):
    df = table("label int", [(0,), (0,), (0,), (1,)])
    assert rows(f.class_weights(df, "label")) == [(0, 4 / 6), (1, 2.0)]


def test_csv_with_line_breaks(spark, table, rows, tmp_path):
    df = table("row_id long, hadm_id long, charttime timestamp_ntz, category string, text string", [(1, 1, "2020-01-01 00:00:00", "x", 'two\nlines, "quoted"'), (2, None, None, None, "b")])
    path = str(tmp_path / "notes")
    writers.save_csv(df, path)
    back = readers.read_csv(spark, path, SCHEMAS["noteevents"], multi_line=True)
    assert rows(back) == rows(df)


def test_csv_nan_and_bad_numbers_become_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,NaN\n2,x\n3,1.5\n")
    out = readers.read_csv(spark, str(tmp_path / "a.csv"), "k long, v double", multi_line=False)
    assert [(r.k, r.v) for r in out.orderBy("k").collect()] == [(1, None), (2, None), (3, 1.5)]


def test_repair_csv_joins_any_number_of_cells(spark, rows, tmp_path):
    (tmp_path / "w.csv").write_text('row_id,icd\n"1","0","0","0",",x"\n"1",",","x","y","z","w"\n1,"2"\n')
    out = readers.repair_csv(spark, str(tmp_path / "w.csv"), ["row_id", "icd"])
    assert rows(out) == sorted([("1000", "x"), ("1", "xyzw"), ("12", None)], key=lambda t: tuple((v is None, str(v)) for v in t))


def test_repair_csv(spark, rows, tmp_path):
    (tmp_path / "d.csv").write_text('ROW_ID,ICD\n"1,5849"\n"2,","4010"\n3,\n')
    out = readers.repair_csv(spark, str(tmp_path / "d.csv"), ["row_id", "icd"])
    assert rows(out) == [("1", "5849"), ("2", "4010"), ("3", None)]


def test_rows_from_filenames(spark, rows, tmp_path):
    for name in ("_1_10_100_2_5849_", "2_20_200_1_4010"):
        (tmp_path / name).write_text("")
    os.makedirs(tmp_path / "empty")
    out = readers.rows_from_filenames(spark, str(tmp_path), ["row_id", "subject_id", "hadm_id", "seq_num", "icd9_code"])
    assert rows(out) == [("1", "10", "100", "2", "5849"), ("2", "20", "200", "1", "4010")]


def test_quality_report_and_columns(spark, table, rows):
    df = table("a long", [(1,)])
    assert rows(readers.quality_report({"one": df, "none": df.limit(0)})) == [("none", 0, True), ("one", 1, False)]
    with pytest.raises(ValueError, match="missing columns: b"):
        readers.require_columns(df, "A", "b")


def test_pruning_and_pushdown(spark):
    df = readers.read_columns(spark, "/root/testdata/sf0.001/orders.parquet", "o_orderkey", "o_orderstatus").where("o_orderstatus LIKE 'F%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_save_table_replaces(spark, table, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS wardlens_test")
    for value in (1, 2):
        out = writers.save_table(table("a long", [(value,)]), "wardlens_test.replaced")
    assert rows(out) == [(2,)] == rows(readers.read_table(spark, "wardlens_test.replaced"))
    spark.sql("DROP DATABASE wardlens_test CASCADE")


def test_cross_counts_keep_every_value(table, rows):
    from wardlens.plans import notes

    df = table("cluster int, category int", [(0, 3), (0, 3), (0, 12), (1, None), (1, 3)])
    want = [(0, 3, 2), (0, 12, 1), (0, None, 0), (1, 3, 1), (1, 12, 0), (1, None, 1)]
    assert set(rows(notes.cross_counts(df, "cluster", "category"))) == set(want)
