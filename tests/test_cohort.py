from wardlens.plans import cohort as c

ADM = "hadm_id long, subject_id long, admittime timestamp_ntz, dischtime timestamp_ntz, hospital_expire_flag int, ethnicity string"
DIAG = "hadm_id long, subject_id long, seq_num int, icd9_code string"


def adm(table, *rows):
    return table(ADM, [(h, s, a, d, x, e) for h, s, a, d, x, e in rows])


def test_readmission_limits_ties_and_missing_gap(table, rows):
    stays = [
        (1, 1, "2020-01-01 10:00:00", "2020-01-05 10:00:00", 0, "A"),  # single stay
        (2, 2, "2020-01-01 10:00:00", "2020-01-05 23:59:00", 0, "A"),
        (3, 2, "2020-01-12 00:01:00", "2020-01-13 00:00:00", 0, "A"),  # 7 calendar days later
        (4, 2, "2020-02-12 00:00:00", "2020-02-13 00:00:00", 0, "A"),  # 30 days later
        (5, 2, "2020-04-13 00:00:00", "2020-04-20 00:00:00", 0, "A"),  # 60 days later
        (6, 2, "2020-06-20 00:00:00", "2020-06-21 00:00:00", 0, "A"),  # 61 days later
        (7, 2, "2020-06-20 12:00:00", "2020-06-21 00:00:00", 0, "A"),  # before discharge
        (8, 3, "2020-01-01 10:00:00", "2020-01-02 00:00:00", 0, "A"),  # tied times
        (9, 3, "2020-01-01 10:00:00", "2020-01-02 00:00:00", 0, "A"),
        (10, 2, "2020-01-13 00:00:00", "2020-01-14 00:00:00", 0, "A"),  # not in the cohort
    ]
    codes = [(h, s, 2, "5849") for h, s, *_ in stays[:-1]] + [(1, 1, 5, "5841"), (10, 2, 1, "4010")]
    out = c.readmissions(table(DIAG, codes), adm(table, *stays))
    got = {r.hadm_id: (r.days_until_next, r.readmitted_within_60_days, r.readmitted_within_30_days, r.readmitted_within_7_days) for r in out.collect()}
    assert got == {
        1: (None, "NO", "NO", "NO"),
        2: (7, "YES", "YES", "YES"),
        3: (30, "YES", "YES", "NO"),
        4: (60, "YES", "NO", "NO"),
        5: (61, "NO", "NO", "NO"),
        6: (-1, "YES", "YES", "YES"),
        7: (None, "NO", "NO", "NO"),
        8: (-1, "YES", "YES", "YES"),
        9: (None, "NO", "NO", "NO"),
    }
    rate = c.readmission_rate(out, 7).collect()[0]
    assert (rate.total_admissions, rate.readmissions, rate.readmission_rate_percent) == (9, 3, 34.0)


def test_fan_out_and_dedup(table, rows):
    admissions = adm(
        table,
        (1, 1, "2020-01-01 00:00:00", "2020-01-03 00:00:00", 1, "A"),
        (2, 1, "2020-03-01 00:00:00", "2020-03-03 00:00:00", 0, "A"),
    )
    codes = table(DIAG, [(1, 1, 1, "5849"), (1, 1, 1, "5845"), (2, 1, 1, "4010")])
    plain = c.share_by_ethnicity(codes, admissions, more_than=0).collect()[0]
    assert (plain.cases, plain.all_admissions, plain.percentage) == (4, 2, 200.0)
    once = c.share_by_ethnicity(codes, admissions, more_than=0, dedup=True).collect()[0]
    assert (once.cases, once.percentage) == (2, 100.0)
    assert rows(c.mortality_by_stay_length(codes, admissions)) == [(2, 2, 2, 100.0)]
    assert rows(c.mortality_by_stay_length(codes, admissions, dedup=True)) == [(2, 1, 1, 100.0)]
    units = table("hadm_id long, first_careunit string", [(1, "U"), (1, "U")])
    assert rows(c.mortality_by_unit(codes, admissions, units)) == [("U", 1, 2, 200.0)]
    assert rows(c.mortality_by_unit(codes, admissions, units, dedup=True)) == [("U", 1, 1, 100.0)]


def test_comorbidity_counts_each_index_row(table, rows):
    names = table("icd9_code string, short_title string, long_title string", [("5849", "K", "k"), ("5845", "K", "k"), ("4010", "H", "h"), ("4011", "H", "h2")])
    codes = table(DIAG, [(1, 1, 1, "5849"), (1, 1, 1, "5845"), (1, 1, 2, "4010"), (1, 1, 3, "4011"), (1, 1, 4, "9999"), (1, 1, 4, None), (2, 1, 2, "4010")])
    assert rows(c.comorbidities(codes, names)) == [("H", 2), ("H", 2)]
    assert rows(c.comorbidities(codes, names, position=2)) == [("H", 2)]
    assert rows(c.comorbidities_by_index(codes, names, more_than=1)) == [("K", "H", 2), ("K", "H", 2)]


def test_creatinine_bands_without_value(table, rows):
    admissions = adm(table, *[(h, h, "2020-01-01 00:00:00", "2020-01-03 00:00:00", h % 2, "A") for h in (1, 2, 3, 4)])
    codes = table(DIAG, [(h, h, 1, "5849") for h in (1, 2, 3, 4)])
    labs = table("subject_id long, itemid long, valuenum double", [(1, 7, 1.19), (2, 7, 1.2), (2, 7, 2.0), (3, 7, None), (4, 8, 9.0)])
    items = table("itemid long, label string", [(7, "Creatinine"), (8, "Other")])
    out = rows(c.mortality_by_creatinine(codes, admissions, labs, items))
    assert out == [("Mildly Elevated", 1, 0, 0.0), ("Normal", 1, 1, 100.0), ("Severely Elevated", 1, 1, 100.0)]


def test_dose_text(table, rows):
    admissions = adm(table, (1, 1, "2020-01-01 00:00:00", "2020-01-03 00:00:00", 0, "A"))
    codes = table(DIAG, [(1, 1, 1, "5849")])
    drugs = table(
        "subject_id long, hadm_id long, drug string, dose_val_rx string",
        [(1, 1, "a", "1.5"), (1, 1, "b", "0.5"), (1, 1, "c", "10-20"), (1, 1, "d", "n/a"), (1, 1, "e", None), (2, 2, "f", "3")],
    )
    assert rows(c.drug_doses(codes, admissions, drugs)) == [("a", 1.0, 1), ("b", 0.0, 1), ("c", 10.0, 1), ("d", None, 1)]


def _aggregates(df):
    """Aggregate and window nodes of the optimised plan, one line each."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Aggregate [" in line or "Window [" in line]


def test_no_aggregate_holds_a_note_text(spark):
    import __spark_entry__ as entry

    for name in ("ml11_multimodal_table", "ag14_first_present"):
        nodes = _aggregates(entry.queries()[name](spark, "/root/testdata/sf0.01"))
        assert nodes and not any("text#" in line.replace("_has_text#", "") for line in nodes), name


def test_cohort_is_cut_down_before_aggregates(spark):
    import __spark_entry__ as entry

    for name in ("cq03_comorbidities_by_index", "cq23_mortality_by_creatinine"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan, name


def test_stored_table_is_read_without_a_shuffle(spark, tmp_path):
    import __spark_entry__  # noqa: F401
    from wardlens.catalog.bindings import Tables
    from wardlens.plans import cohort as c

    t = Tables(spark, "/root/testdata/sf0.01")
    for _ in range(2):  # created, then replaced
        stored = c.store_readmissions(t.diagnoses, t.admissions, "wardlens_readmissions_test", buckets=6, path=str(tmp_path / "r"))
    assert stored.count() == c.readmissions(t.diagnoses, t.admissions).count()

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(c.subject_readmissions(stored))
    rates = plan(c.readmission_rates(stored))  # the one exchange moves a row of counts per task
    assert rates.count("Exchange") == rates.count("Exchange SinglePartition") == 1
    spark.sql("DROP TABLE wardlens_readmissions_test")
