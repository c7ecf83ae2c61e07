import pytest
from pyspark.sql import functions as F

from wardlens import fixed_values as fv
from wardlens.plans import answers as a
from wardlens.plans.passes import Transcript, vote

CASES = [(1, "Flu", ["fever", "cough"]), (2, "Gout", ["pain"]), (3, "Flu", [])]
SCHEMA = "case_id long, disease string, symptoms array<string>"


def ways():
    """Local functions, so that workers get them by value."""

    def direct(prompt, system):
        if "Symptoms: pain" in prompt:
            raise TimeoutError("down")
        return " Flu "

    def chain(prompt, system):
        return "Thinking. The diagnosis is: Cold" if "fever" in prompt else "no idea"

    def few_shot(prompt, system):
        return "Gout" if "Symptoms: x\nDisease: y" in prompt else "no examples"

    def confidence(prompt, system):
        return "DISEASE: Cold\nCONFIDENCE: 90%\nDISEASE: Gout\nCONFIDENCE: 60%\nDISEASE: Flu\nCONFIDENCE: 60%"

    return {"direct": direct, "chain": chain, "few_shot": few_shot, "confidence": confidence}


def job(cases, log):
    responders = [log.of(name, a.python_responder(way, "case_id")) for name, way in ways().items()]
    return vote(cases, F.lit("Flu, Gout"), "Symptoms: x\nDisease: y\n", *responders)


def test_vote_asks_four_times_and_keeps_what_was_asked(table):
    log = Transcript()
    out = {r.case_id: r for r in job(table(SCHEMA, CASES), log).collect()}
    assert {k: (r.predictions, r.final_prediction, r.final_confidence) for k, r in out.items()} == {
        1: (["Flu", "Cold", "Gout"], "Cold", 90),
        2: ([fv.FAILED, fv.FAILED, "Gout"], "Gout", 60),
        3: (["Flu", "Flu", "Gout"], "Flu", 60),
    }
    asked = {(r["pass"], r.case_id): r for r in log.table().collect()}
    assert len(asked) == 12
    assert asked["direct", 2].answer == fv.FAILED
    assert "Possible diagnoses:\nCold, Flu, Gout\n" in asked["confidence", 1].prompt
    assert asked["few_shot", 3].system == fv.SYSTEM["vote_few_shot"]


def test_transcript_reads_written_prompts(table):
    """The record scans written tables only: nothing is rendered or asked again."""
    log = Transcript()
    job(table(SCHEMA, CASES), log)
    plan = log.table()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "symptoms" not in plan and "parquet" in plan


def test_vote_without_cases(table):
    log = Transcript()
    assert job(table(SCHEMA, []), log).collect() == []
    assert log.table().collect() == []
    with pytest.raises(ValueError):
        Transcript().table()


def test_narrowing_on_record(table):
    listed = {1: "1. Flu\n2. Cold", 2: "1. Gout"}
    known = table("case_id long, listed string, ranked string", [(k, v, "RANKING:\n1. Cold") for k, v in listed.items()])
    log = Transcript()
    cases = table(SCHEMA, CASES)
    out = a.narrow_down(
        cases, a.class_names(cases, "disease"),
        log.of("list", a.recorded(known, "case_id", "listed")), log.of("rank", a.recorded(known, "case_id", "ranked")),
    )
    assert {r.case_id: r.prediction for r in out.collect()} == {1: "Cold", 2: "Gout", 3: fv.FAILED}
    assert sorted((r["pass"], r.case_id) for r in log.table().collect()) == [("list", 1), ("list", 2), ("list", 3), ("rank", 1)]
