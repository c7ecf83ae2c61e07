from pyspark.sql import functions as F

from pyspark.sql import functions as F
from wardlens import fixed_values as fv
from wardlens.plans import answers as a


def texts(table, *values):
    return table("k long, t string", list(enumerate(values)))


def test_clean_answers(table, rows):
    df = texts(table, "The disease is Flu. Because", "disease: Flu", "ERROR", "The patient has Disease: Flu", "Flu")
    assert rows(df.select("k", a.clean_answer("t"))) == [(0, "Flu"), (1, "Flu"), (2, "ERROR"), (3, "Flu"), (4, "Flu")]


def test_final_answer_and_lists(table, rows):
    df = texts(table, "x The most likely disease is: Flu (mild)", "nothing", "1. Flu\n2.  Cold (bad)\nx 3. no\n12. Gout\n")
    assert rows(df.select("k", a.final_answer("t"))) == [(0, "Flu"), (1, fv.NO_ANSWER), (2, fv.NO_ANSWER)]
    assert rows(a.list_rows(df, "k", "t")) == [(2, 0, "Flu"), (2, 1, "Cold"), (2, 2, "Gout")]


def test_first_ranked(table, rows):
    df = table("k long, t string, c array<string>", [(1, "RANKING:\n1. Flu\n2. Cold", ["x"]), (2, "no", ["x", "y"]), (3, "no", [])])
    assert rows(df.select("k", a.first_ranked("t", F.col("c")))) == [(1, "Flu"), (2, "x"), (3, "Unknown")]


def test_responder_marks_failed_calls(table, rows):
    cases = a.with_prompt(table("case_id long, symptoms array<string>", [(1, ["a", "b"]), (2, [])]), "zero_shot", classes="x, y")

    def answer(prompt, system):
        if "Symptoms: a, b" not in prompt:
            raise RuntimeError("down")
        return "  x \n"

    out = a.python_responder(answer, "case_id", parallelism=2)(cases)
    assert rows(out) == [(1, "x"), (2, "ERROR")]


def test_prompt_text(table):
    cases = table("case_id long, symptoms array<string>", [(1, ["{classes}", "b"])])
    prompt = a.with_prompt(cases, "role", classes="Flu, Cold").collect()[0]
    assert prompt.prompt == fv.PROMPT["role"].replace("{classes}", "Flu, Cold").replace("{symptoms}", "{classes}, b")
    assert prompt.system == fv.SYSTEM["role"]


def test_severity(table, rows):
    cases = table("case_id long, symptoms array<string>", [(1, ["zzz"]), (2, []), (3, ["two", "three"]), (4, ["two"]), (5, ["two", "two", "five"])])
    weights = table("symptom string, weight int", [("two", 2), ("three", 3), ("five", 5)])
    answers = table("case_id long, answer string", [(1, "?"), (2, "?"), (3, "?"), (4, "Severity: 7/10 bad"), (5, "?")])
    out = a.severity_scores(answers, a.baseline_severity(cases, weights))
    assert rows(out, "case_id", "baseline", "severity", "urgency") == [
        (1, 0.0, 0, None), (2, 0.0, 0, None), (3, 2.5, 2, fv.URGENCY[0][2]), (4, 2.0, 7, fv.URGENCY[2][2]), (5, 3.0, 3, fv.URGENCY[0][2])
    ]


def test_category_map(spark, table, rows):
    members = a.fixed_members(spark)
    cases = table("disease string", [("Pneumonia",), ("Pneumonia",), ("Odd",), ("Hepatitis",)])
    mapping = a.category_map(members, cases)
    got = dict(rows(mapping.where(F.col("disease").isin("Pneumonia", "Odd", "Hepatitis", "Impetigo"))))
    assert got == {"Pneumonia": "Respiratory", "Odd": "Other", "Hepatitis": "Digestive", "Impetigo": "Skin"}
    assert rows(a.category_counts(mapping, cases)) == [("Digestive", 1), ("Other", 1), ("Respiratory", 1)]
    sets = {r.category: set(r.candidates) for r in a.candidate_sets(members, mapping).collect()}
    first_two = {d for names in fv.DISEASE_CATEGORIES.values() for d in names[:2]} | {"Odd"}
    assert sets["Skin"] == set(fv.DISEASE_CATEGORIES["Skin"]) | first_two
    assert sets["Other"] == first_two
    answers = table("case_id long, answer string", [(1, "Skin"), (2, "nonsense")])
    settled = rows(a.settle_category(answers, a.candidate_sets(members, mapping)), "case_id", "category")
    assert settled == [(1, "Skin"), (2, "Digestive")]


def test_votes(table, rows):
    df = table(
        "k long, d string, c string, f string, conf string",
        [
            (1, "Flu", "the diagnosis is: Cold.", " Flu", "DISEASE: Cold\nx\nCONFIDENCE: 80%\nDISEASE: Flu\nCONFIDENCE: 60%"),
            (2, "B", "no idea", "A", "nothing"),
            (3, "A (x)", "?", "A (x)", "a (x) confidence 7%"),
        ],
    )
    out = a.weigh_votes(a.votes(df, "d", "c", "f"), "conf")
    assert rows(out, "k", "final_prediction", "final_confidence") == [(1, "Cold", 80), (2, "A", 50), (3, "A (x)", 7)]


def test_treatment_context_leaves_out_own_disease(table, rows):
    pre = table("row_id long, disease string, precaution_1 string, precaution_2 string", [(1, "a", "rest", None), (2, "b", "", None), (3, "c", "x", "y"), (4, "d", "z", ""), (5, "e", "w", ""), (6, "a", "sleep", "")])
    lists = a.precaution_lists(pre, ["precaution_1", "precaution_2"])
    mapping = table("disease string, category string", [(d, "K") for d in "abcde"])
    cases = table("case_id long, disease string, symptoms array<string>", [(1, "a", ["s"]), (2, "b", []), (3, "q", [])])
    out = {r.case_id: (r.known, r.context) for r in a.treatment_context(cases, lists, mapping).collect()}
    line = lambda d, p: f"Disease: {d}\nPrecautions: {p}"
    assert out[1] == ("sleep", "\n\n".join([line("b", ""), line("c", "x; y"), line("d", "z")]))
    assert out[2] == (fv.NO_PRECAUTIONS, "\n\n".join([line("a", "sleep"), line("c", "x; y"), line("d", "z")]))
    assert out[3] == (fv.NO_PRECAUTIONS, "")


def test_two_passes_ask_each_case_once(spark, table, rows, tmp_path):
    cases = table("case_id long, disease string, symptoms array<string>", [(i, "Flu", [f"s{i}"]) for i in range(6)])
    log = str(tmp_path / "calls")

    def first(prompt, system):
        with open(log, "a") as out:
            out.write("first\n")
        case = prompt.split("Given these symptoms: s")[1][0]
        if case == "0":
            raise RuntimeError("down")
        return {"1": "none", "2": "1. Flu"}.get(case, "1. Cold\n2. Flu\n3. Gout\n4. Acne")

    def second(prompt, system):
        with open(log, "a") as out:
            out.write("second\n")
        assert "Cold, Flu, Gout\n" in prompt
        if "symptoms: s3" in prompt:
            raise RuntimeError("down")
        return "RANKING:\n1. Flu\n2. Cold" if "symptoms: s4" in prompt else "unsure"

    out = a.narrow_down(cases, F.array(*[F.lit(x) for x in ["Cold", "Flu"]]), a.python_responder(first, "case_id"), a.python_responder(second, "case_id"))
    assert rows(out, "case_id", "prediction") == [
        (0, fv.FAILED), (1, fv.NO_ANSWER), (2, "Flu"), (3, fv.FAILED), (4, "Flu"), (5, "Cold")
    ]
    out.count()
    calls = open(log).read().split()
    assert calls.count("first") == 6 and calls.count("second") == 3


def test_numbers_too_long_count_as_unstated(spark):
    answers = spark.createDataFrame([(1, "Severity: 99999999999/10"), (2, "Severity: 7/10")], "case_id int, answer string")
    base = spark.createDataFrame([(1, 2.5), (2, 2.5)], "case_id int, baseline double")
    got = {r.case_id: r.severity for r in a.severity_scores(answers, base).collect()}
    assert got == {1: 2, 2: 7}
    text = r"odd\Ename CONFIDENCE: 99999999999% flu confidence: 80%"
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.lit(text).alias("t"))
    names = [r"Odd\Ename", "Flu", "cold"]
    assert list(one.select(*[a.confidence_of(F.lit(x), F.col("t")).alias(x[:2]) for x in names]).first()) == [50, 80, 50]


def test_mixed_takes_any_key_and_spreads_neighbours(spark):
    from pyspark.sql import functions as F

    from wardlens.functions.scalars import MIXED_END, mixed

    test = spark.range(10_000).select(F.floor(F.col("id") / 1000).alias("block"), (mixed("id") < 0.2 * MIXED_END).cast("int").alias("t"))
    shares = [r[1] for r in test.groupBy("block").agg(F.avg("t")).collect()]
    assert all(0.15 < s < 0.25 for s in shares)
    assert spark.range(1).select(mixed(F.lit("a-b"))).first()[0] >= 0


def test_a_second_run_asks_nothing(table, rows, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    cases = table(
        "case_id long, prompt string, system string",
        [(1, "a", None), (2, "a", None), (3, "a", ""), (4, "bad", None), (5, "late", "s"), (6, None, None)],
    )

    def answer(prompt, system):
        import uuid

        (log / f"{prompt}-{system}-{uuid.uuid4().hex}").touch()
        if prompt == "bad" or (prompt == "late" and len(list(log.glob("late*"))) < 2):
            raise RuntimeError("down")
        return f"{prompt} of {system}"

    want = [(1, "a of None"), (2, "a of None"), (3, "a of"), (4, "ERROR"), (5, "late of s"), (6, "ERROR")]
    for made in (1 + 1 + 3 + 2, 1 + 1 + 3 + 2):  # equal prompts once, bad ones three times; then nothing
        ask = a.resumable(lambda key: a.python_responder(answer, key), str(tmp_path / "store"), "case_id")
        assert rows(ask(cases)) == want
        assert len(list(log.iterdir())) == made
    more = a.resumable(lambda key: a.python_responder(answer, key), str(tmp_path / "store"), "case_id", max_tries=4)
    assert rows(more(cases)) == want and len(list(log.iterdir())) == 8


def test_resumed_run_of_no_cases(table, tmp_path):
    none = table("case_id long, prompt string, system string", [(1, "a", None)]).limit(0)
    ask = a.resumable(lambda key: a.python_responder(lambda p, s: p, key), str(tmp_path / "store"), "case_id")
    assert ask(none).count() == 0
