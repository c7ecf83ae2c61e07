"""Prompt jobs LM-1 to LM-21."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wardlens import fixed_values as fv
from wardlens.catalog import query
from wardlens.plans import answers as a
from wardlens.plans import evaluation as e
from wardlens.plans import features as f
from wardlens.plans import passes as ps
from wardlens.session import cut_lineage, scratch_path

SYMPTOMS = [f"symptom_{i}" for i in range(1, 6)]
TRIMMED = ", ".join(f"trim({c})" for c in SYMPTOMS)
CASES = f"""
    SELECT case_id, disease, list_filter([{TRIMMED}], lambda x: x IS NOT NULL AND x <> '') AS symptoms FROM cases"""
TEXT = "array_to_string(symptoms, ', ')"


def _cases(t):
    return a.clean_cases(t.cases, SYMPTOMS)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    """SQL for a fixed text with its places filled by SQL expressions."""
    out = _quoted(template)
    for name, expression in values.items():
        out = f"replace({out}, '{{{name}}}', {expression})"
    return out


CLASSES = "(SELECT string_agg(disease, ', ' ORDER BY disease) FROM (SELECT DISTINCT disease FROM cases))"


@query(
    "lm01_clean_cases",
    f"SELECT case_id, disease, array_to_string(symptoms, '|') AS symptoms, len(symptoms)::INT AS n FROM ({CASES})",
)
def _(t):
    return _cases(t).select(
        "case_id", "disease", F.array_join("symptoms", "|").alias("symptoms"), F.size("symptoms").alias("n")
    )


@query("lm01_case_counts", "SELECT count(DISTINCT disease) AS diseases, count(*) AS samples FROM cases")
def _(t):
    return a.case_counts(_cases(t))


@query("lm01_class_names", "SELECT DISTINCT disease FROM cases")
def _(t):
    return t.spark.range(1).select(F.explode(a.class_names(t.cases, "disease")).alias("disease"))


SPLIT = f"""
    SELECT *, row_number() OVER (PARTITION BY disease ORDER BY CAST('0x' || substr(md5('42:' || CAST(case_id AS VARCHAR)), 1, 13) AS BIGINT), case_id)
                <= floor(0.2 * count(*) OVER (PARTITION BY disease) + 1e-9) AS is_test FROM ({CASES})"""


def _split(t):
    return f.split_stratified(cut_lineage(_cases(t)), "case_id", "disease")


@query(
    "lm02_split",
    f"SELECT disease, count(*) FILTER (WHERE is_test) AS test, count(*) FILTER (WHERE NOT is_test) AS train FROM ({SPLIT}) GROUP BY 1",
)
def _(t):
    return _split(t).groupBy("disease").agg(
        F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train")
    )


for kind in ("zero_shot", "role", "chain", "vote_direct", "vote_chain"):

    @query(
        f"lm03_prompt_{kind}",
        f"""SELECT case_id, {_filled(fv.PROMPT[kind], symptoms=TEXT, classes=CLASSES)} AS prompt,
                   {_quoted(fv.SYSTEM[kind]) if kind in fv.SYSTEM else "NULL::VARCHAR"} AS system FROM ({CASES})""",
    )
    def _(t, kind=kind):
        cases = _cases(t)
        names = F.array_join(a.class_names(cases, "disease"), ", ")
        return a.with_prompt(cases, kind, classes=names).select("case_id", "prompt", "system")


EXAMPLES = f"""(SELECT string_agg('Symptoms: ' || {TEXT} || chr(10) || 'Disease: ' || disease || chr(10), chr(10) ORDER BY o, case_id, disease)
    FROM (SELECT *, CAST('0x' || substr(md5('42:' || CAST(case_id AS VARCHAR)), 1, 13) AS BIGINT) AS o FROM ({SPLIT}) WHERE NOT is_test
          QUALIFY row_number() OVER (PARTITION BY disease ORDER BY o, case_id) = 1 ORDER BY o, case_id, disease LIMIT 5))"""


@query(
    "lm04_few_shot_prompt",
    f"""SELECT case_id, {_filled(fv.PROMPT["few_shot"], examples=EXAMPLES, symptoms=TEXT, classes=CLASSES)} AS prompt
        FROM ({SPLIT}) WHERE is_test""",
)
def _(t):
    split = _split(t)
    examples = a.few_shot_examples(split.where(~F.col("is_test")), 5)
    names = F.array_join(a.class_names(split, "disease"), ", ")
    test = split.where("is_test")
    return a.with_prompt(test, "few_shot", examples=examples, classes=names).select("case_id", "prompt")


def _echo(prompt: str, system: str | None) -> str:
    """Stand-in for a model: repeats the first symptom, fails on one brand and on empty lists."""
    first = re.search(r"Symptoms: ([^,\n]+)", prompt)
    if first is None or first.group(1) == "Brand#7":
        raise ValueError("no answer")
    return f" The disease is {first.group(1)}. Certainly. "


ECHO = "CASE WHEN len(symptoms) = 0 OR symptoms[1] = 'Brand#7' THEN 'ERROR' ELSE 'The disease is ' || symptoms[1] || '. Certainly.' END"


@query("lm05_batch_answers", f"SELECT case_id, {ECHO} AS answer FROM ({CASES})")
def _(t):
    prompted = a.with_prompt(_cases(t), "zero_shot", classes="any")
    return a.python_responder(_echo, "case_id")(prompted)


def _busy(prompt: str, system: str | None) -> str:
    """As _echo, but out of reach for some more prompts."""
    if "Symptoms: Brand#1" in prompt:
        raise TimeoutError("busy")
    return _echo(prompt, system)


def _down(prompt: str, system: str | None) -> str:
    raise ConnectionError("down")


@query(
    "lm05_resumed_answers",
    f"""SELECT case_id, {ECHO} AS answer,
               CASE WHEN {ECHO} = 'ERROR' THEN 3 WHEN starts_with(symptoms[1], 'Brand#1') THEN 2 ELSE 1 END::BIGINT AS calls FROM ({CASES})""",
)
def _(t):
    """Three runs over one store: the first leaves gaps, the second fills them, the third asks nothing."""
    prompted = a.with_prompt(_cases(t), "zero_shot", classes="any")
    folder = scratch_path(t.spark, "answers")
    for answer, tries in ((_busy, 1), (_echo, 3), (_down, 3)):
        answers = a.resumable(lambda key, answer=answer: a.python_responder(answer, key), folder, "case_id", max_tries=tries)(prompted)
    calls = a.answer_store(t.spark, folder).groupBy("prompt_key").agg(F.count(F.lit(1)).alias("calls"))
    keyed = prompted.select("case_id", a.prompt_key().alias("prompt_key")).join(calls, "prompt_key")
    return answers.join(keyed, "case_id").select("case_id", "answer", "calls")


@query(
    "lm05_recorded_answers",
    """SELECT u.conv_id, u.turn, u.text AS prompt, s.text AS answer FROM turns u
       LEFT JOIN turns s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 AND s.role = 'assistant' WHERE u.role = 'user'""",
)
def _(t):
    return a.next_turn_answers(t.turns)


CLEANED = "split_part(direct, '.', 1)"
for _p in fv.ANSWER_PREFIXES:
    CLEANED = f"""(SELECT CASE WHEN starts_with(lower(x), lower('{_p}')) THEN trim(substr(x, {len(_p) + 1})) ELSE x END
                   FROM (SELECT {CLEANED} AS x))"""


@query("lm06_clean_answers", f"SELECT case_id, {CLEANED} AS predicted FROM answers")
def _(t):
    return t.answers.select("case_id", a.clean_answer("direct").alias("predicted"))


SCORED = f"SELECT case_id, disease, direct, {CLEANED} AS predicted, lower({CLEANED}) = lower(disease) AS correct FROM answers"


@query("lm07_scored_answers", SCORED)
def _(t):
    return a.score_answers(t.answers.select("case_id", "disease", "direct"), "disease", "direct")


@query(
    "lm07_answer_accuracy",
    f"SELECT count(*) AS cases, round(avg(correct::INT), 6) AS accuracy FROM ({SCORED})",
)
def _(t):
    scored = a.score_answers(t.answers, "disease", "direct")
    return e.accuracy(scored, "disease", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "lm08_final_answer",
    r"""SELECT case_id, CASE WHEN regexp_matches(chain, 'The most likely disease is:?\s*([A-Za-z\s]+)')
                             THEN trim(regexp_extract(chain, 'The most likely disease is:?\s*([A-Za-z\s]+)', 1))
                             ELSE 'Could not determine' END AS final FROM answers""",
)
def _(t):
    return t.answers.select("case_id", a.final_answer("chain").alias("final"))


LISTED = r"""list_transform(list_filter(string_split(listed, chr(10)), lambda s: regexp_matches(s, '^\d+\.\s*[A-Za-z\s]')),
                            lambda s: trim(regexp_extract(s, '^\d+\.\s*([A-Za-z\s]+)', 1)))"""


@query(
    "lm09_ranked_list",
    f"""SELECT case_id, (pos - 1)::INT AS pos, names[pos] AS name
        FROM (SELECT case_id, {LISTED} AS names FROM answers), range(1, 20) r(pos) WHERE pos <= len(names)""",
)
def _(t):
    return a.list_rows(t.answers, "case_id", "listed")


RANKED = r"""CASE WHEN regexp_matches(ranking, 'RANKING:\s*1\.\s*([A-Za-z\s]+)')
                  THEN trim(regexp_extract(regexp_extract(ranking, 'RANKING:\s*1\.\s*([A-Za-z\s]+)', 1), '[^\n]+'))
                  ELSE coalesce(names[1], 'Unknown') END"""


@query(
    "lm10_first_ranked",
    f"SELECT case_id, {RANKED} AS first FROM (SELECT case_id, ranking, {LISTED} AS names FROM answers)",
)
def _(t):
    return t.answers.select("case_id", a.first_ranked("ranking", a.listed_names("listed")).alias("first"))


@query(
    "lm11_narrow_down",
    f"""SELECT case_id, disease, array_to_string(names, '|') AS potential,
               CASE WHEN listed IS NULL THEN 'ERROR' WHEN len(names) = 0 THEN 'Could not determine'
                    WHEN len(names) = 1 THEN names[1] ELSE {RANKED} END AS prediction
        FROM (SELECT case_id, disease, listed, ranking, {LISTED.replace("listed", "coalesce(listed, 'ERROR')")} AS names FROM answers)""",
)
def _(t):
    cases = _cases(t)
    out = a.narrow_down(
        cases,
        a.class_names(cases, "disease"),
        a.recorded(t.answers, "case_id", "listed"),
        a.recorded(t.answers, "case_id", "ranking"),
    )
    return out.select("case_id", "disease", F.array_join("potential", "|").alias("potential"), "prediction")


def _asked(name: str, kind: str, answer: str, **places: str) -> str:
    """SQL columns of one pass: digest of its prompt, its system text and its answer."""
    system = _filled(fv.SYSTEM[kind], **places) if kind in fv.SYSTEM else "NULL::VARCHAR"
    return f"""case_id, '{name}' AS pass, md5({_filled(fv.PROMPT[kind], symptoms=TEXT, **places)}) AS prompt_digest,
               {system} AS system, coalesce(trim({answer}), 'ERROR') AS answer"""


def _recorded(t, log, *names, **columns):
    """Recorded answers as responders on record, a pass for each name, from a column of that or another name."""
    return [log.of(x, a.recorded(t.answers, "case_id", columns.get(x, x))) for x in names]


def _transcript(log):
    return log.table().select("case_id", "pass", F.md5("prompt").alias("prompt_digest"), "system", "answer")


@query(
    "lm11_transcript",
    f"""WITH known AS (SELECT c.*, listed, ranking, {LISTED.replace("listed", "coalesce(trim(listed), 'ERROR')")} AS names
                       FROM ({CASES}) c LEFT JOIN answers a ON c.case_id = a.case_id)
        SELECT {_asked("list", "list", "listed", classes=CLASSES, how_many="'7'")} FROM known
        UNION ALL SELECT {_asked("rank", "rank", "ranking", candidates="array_to_string(names[1:3], ', ')")} FROM known WHERE len(names) > 1""",
)
def _(t):
    """Prompts and answers of both passes of the narrowing job."""
    cases, log = _cases(t), ps.Transcript()
    a.narrow_down(cases, a.class_names(cases, "disease"), *_recorded(t, log, "list", "rank", list="listed", rank="ranking"))
    return _transcript(log)


MAPPING = """
    SELECT disease, arg_max(category, pos) AS category FROM category_members GROUP BY 1
    UNION ALL SELECT DISTINCT disease, 'Other' FROM cases WHERE disease NOT IN (SELECT disease FROM category_members)"""


@query("lm12_category_map", MAPPING)
def _(t):
    return a.category_map(t.category_members, t.cases)


@query(
    "lm12_category_counts",
    f"SELECT category, count(*) AS diseases FROM ({MAPPING}) WHERE disease IN (SELECT disease FROM cases) GROUP BY 1",
)
def _(t):
    return a.category_counts(a.category_map(t.category_members, t.cases), t.cases)


SETS = f"""
    SELECT c.category, list_sort(list_distinct(list(x.disease))) AS candidates, any_value(c.size) AS size
    FROM (SELECT category, count(*) AS size FROM everyone GROUP BY 1) c
    JOIN (SELECT *, row_number() OVER (PARTITION BY category ORDER BY late, pos, disease) AS rn FROM everyone) x
      ON x.category = c.category OR x.rn <= 2 GROUP BY 1"""
EVERYONE = f"""
    WITH everyone AS (SELECT category, disease, 0 AS late, pos FROM category_members
                      UNION ALL SELECT category, disease, 1, 0 FROM ({MAPPING})
                      WHERE disease NOT IN (SELECT disease FROM category_members)) """


@query(
    "lm13_candidate_sets",
    EVERYONE + f"SELECT category, array_to_string(candidates, ', ') AS candidates, size FROM ({SETS})",
)
def _(t):
    sets = a.candidate_sets(t.category_members, a.category_map(t.category_members, t.cases))
    return sets.withColumn("candidates", F.array_join("candidates", ", "))


@query(
    "lm13_settled_category",
    EVERYONE
    + f""", sets AS ({SETS}), settled AS (
          SELECT case_id, CASE WHEN category IN (SELECT category FROM sets) THEN category
                 ELSE (SELECT category FROM sets ORDER BY size DESC, category DESC LIMIT 1) END AS category FROM answers)
        SELECT case_id, s.category, array_to_string(candidates, ', ') AS candidates FROM settled s JOIN sets USING (category)""",
)
def _(t):
    sets = a.candidate_sets(t.category_members, a.category_map(t.category_members, t.cases))
    answered = t.answers.select("case_id", F.col("category").alias("answer"))
    return a.settle_category(answered, sets).select(
        "case_id", "category", F.array_join("candidates", ", ").alias("candidates")
    )


def _by_category(t):
    return a.by_category(
        _cases(t),
        t.category_members,
        a.recorded(t.answers, "case_id", "category"),
        a.recorded(t.answers, "case_id", "few_shot"),
    )


@query(
    "lm14_by_category",
    EVERYONE
    + f""", sets AS ({SETS})
        SELECT case_id, disease, CASE WHEN category IN (SELECT category FROM sets) THEN category
                 ELSE (SELECT category FROM sets ORDER BY size DESC, category DESC LIMIT 1) END AS predicted_category,
               trim(few_shot) AS predicted FROM answers""",
)
def _(t):
    return _by_category(t)


@query(
    "lm14_transcript",
    EVERYONE
    + f""", sets AS ({SETS}), known AS (
          SELECT c.*, a.category, few_shot FROM ({CASES}) c LEFT JOIN answers a ON c.case_id = a.case_id), settled AS (
          SELECT k.* EXCLUDE (category), s.category, candidates FROM known k JOIN sets s ON s.category =
                 CASE WHEN trim(k.category) IN (SELECT category FROM sets) THEN trim(k.category)
                      ELSE (SELECT category FROM sets ORDER BY size DESC, category DESC LIMIT 1) END)
        SELECT {_asked("category", "category", "category", categories=f"(SELECT string_agg(category, ', ' ORDER BY category) FROM (SELECT DISTINCT category FROM ({MAPPING})))")} FROM known
        UNION ALL SELECT {_asked("within", "within_category", "few_shot", category="category", candidates="array_to_string(candidates, ', ')")} FROM settled""",
)
def _(t):
    """Prompts and answers of both passes of the job by category."""
    log = ps.Transcript()
    a.by_category(_cases(t), t.category_members, *_recorded(t, log, "category", "within", within="few_shot"))
    return _transcript(log)


@query(
    "lm14_by_category_against_direct",
    f"""SELECT round(b, 6) AS first_accuracy, round(d, 6) AS second_accuracy,
               CASE WHEN d > b THEN 'second' WHEN b > d THEN 'first' ELSE 'equal' END AS winner
        FROM (SELECT avg((lower(trim(few_shot)) = lower(disease))::INT) AS b, avg((lower({CLEANED}) = lower(disease))::INT) AS d
              FROM answers)""",
)
def _(t):
    direct = t.answers.select("case_id", a.clean_answer("direct").alias("direct"))
    both = _by_category(t).join(direct, "case_id")
    out = e.method_winner(e.compare_methods(both, "case_id", "disease", "predicted", "direct"))
    return out.select(
        F.round("first_accuracy", 6).alias("first_accuracy"), F.round("second_accuracy", 6).alias("second_accuracy"), "winner"
    )


LEVEL_TEXT = """(SELECT string_agg('Symptoms: ' || names || chr(10) || 'Severity: ' || weight || '/10', chr(10) || chr(10) ORDER BY weight)
    FROM (SELECT weight, string_agg(symptom, ', ' ORDER BY symptom) AS names
          FROM (SELECT * FROM severities WHERE weight IN (1, 3, 5, 7)
                QUALIFY row_number() OVER (PARTITION BY weight ORDER BY symptom) <= 3) GROUP BY 1))"""


@query("lm15_severity_examples", f"SELECT {LEVEL_TEXT} AS examples")
def _(t):
    return a.severity_examples(t.severities)


@query(
    "lm15_severity_prompts",
    f"""SELECT case_id, {_filled(fv.PROMPT["severity"], examples=LEVEL_TEXT, symptoms=TEXT)} AS prompt FROM ({CASES})""",
)
def _(t):
    examples = a.severity_examples(t.severities).scalar()
    return a.with_prompt(_cases(t), "severity", examples=examples).select("case_id", "prompt")


BASELINE = f"""
    SELECT c.case_id, coalesce(avg(coalesce(weight, 0)) FILTER (WHERE s IS NOT NULL), 0) AS baseline
    FROM (SELECT case_id, unnest(CASE WHEN len(symptoms) = 0 THEN [NULL] ELSE symptoms END) AS s FROM ({CASES})) c
    LEFT JOIN severities v ON v.symptom = c.s GROUP BY 1"""


@query("lm17_baseline_severity", f"SELECT case_id, round(baseline, 6) AS baseline FROM ({BASELINE})")
def _(t):
    out = a.baseline_severity(_cases(t), t.severities)
    return out.withColumn("baseline", F.round("baseline", 6))


@query(
    "lm16_severity_scores",
    rf"""SELECT *, CASE WHEN severity BETWEEN 1 AND 3 THEN 'Mild - can be managed at home'
                WHEN severity BETWEEN 4 AND 6 THEN 'Moderate - should consult a doctor soon'
                WHEN severity BETWEEN 7 AND 8 THEN 'Severe - needs prompt medical attention'
                WHEN severity BETWEEN 9 AND 10 THEN 'Critical - requires emergency care' END AS urgency
         FROM (SELECT a.case_id, CASE WHEN regexp_matches(severity, 'Severity:\s*(\d+)/10')
                      THEN regexp_extract(severity, 'Severity:\s*(\d+)/10', 1)::INT ELSE round_even(baseline, 0)::INT END AS severity
               FROM answers a JOIN ({BASELINE}) b ON a.case_id = b.case_id)""",
)
def _(t):
    answered = t.answers.select("case_id", F.col("severity").alias("answer"))
    return a.severity_scores(answered, a.baseline_severity(_cases(t), t.severities)).select(
        "case_id", "severity", "urgency"
    )


PRECAUTION_COLUMNS = [f"precaution_{i}" for i in range(1, 5)]
LISTS = """
    SELECT disease, arg_max(p, row_id) AS precautions, min(row_id) AS first_row
    FROM (SELECT *, list_filter([precaution_1, precaution_2, precaution_3, precaution_4],
                                lambda x: x IS NOT NULL AND x <> '') AS p FROM precautions) GROUP BY 1"""


@query(
    "lm18_precautions",
    f"SELECT disease, array_to_string(precautions, '; ') AS precautions, first_row FROM ({LISTS})",
)
def _(t):
    return a.precaution_lists(t.precautions, PRECAUTION_COLUMNS).withColumn(
        "precautions", F.array_join("precautions", "; ")
    )


CONTEXT = f"""
    WITH mapping AS ({MAPPING}), lists AS (SELECT l.*, coalesce(m.category, 'Other') AS category FROM ({LISTS}) l
                                           LEFT JOIN mapping m ON m.disease = l.disease),
    pairs AS (SELECT d.disease, x.disease AS other, x.precautions, x.first_row
              FROM (SELECT DISTINCT c.disease, coalesce(m.category, 'Other') AS category FROM cases c
                    LEFT JOIN mapping m ON m.disease = c.disease) d
              JOIN lists x ON x.category = d.category AND x.disease <> d.disease
              QUALIFY row_number() OVER (PARTITION BY d.disease ORDER BY x.first_row) <= 3),
    texts AS (SELECT disease, string_agg('Disease: ' || other || chr(10) || 'Precautions: ' || array_to_string(precautions, '; '),
                                         chr(10) || chr(10) ORDER BY first_row) AS context FROM pairs GROUP BY 1),
    ctx AS (SELECT c.case_id, c.disease, symptoms, coalesce(m.category, 'Other') AS category,
                   CASE WHEN len(l.precautions) > 0 THEN array_to_string(l.precautions, '; ')
                        ELSE 'No specific precautions in database' END AS known, coalesce(x.context, '') AS context
            FROM ({CASES}) c LEFT JOIN mapping m ON m.disease = c.disease LEFT JOIN lists l ON l.disease = c.disease
            LEFT JOIN texts x ON x.disease = c.disease) """


def _context(t):
    cases = _cases(t)
    return a.treatment_context(
        cases, a.precaution_lists(t.precautions, PRECAUTION_COLUMNS), a.category_map(t.category_members, cases)
    )


@query("lm19_treatment_context", CONTEXT + "SELECT case_id, disease, category, known, context FROM ctx")
def _(t):
    return _context(t).drop("symptoms")


@query(
    "lm19_treatment_prompts",
    CONTEXT
    + f"""SELECT case_id, {_filled(fv.PROMPT["treatment"], symptoms=TEXT, disease="disease", category="category", known="known", context="context")} AS prompt,
                 {_filled(fv.SYSTEM["treatment"], category="category")} AS system FROM ctx""",
)
def _(t):
    return a.treatment_prompts(_context(t)).select("case_id", "prompt", "system")


VOTES = r"""
    SELECT case_id, disease, confidence, [trim(direct), CASE WHEN regexp_matches(chain, '(?i)diagnosis is:?\s*([A-Za-z\s]+)')
        THEN trim(regexp_extract(chain, '(?i)diagnosis is:?\s*([A-Za-z\s]+)', 1)) ELSE trim(direct) END, trim(few_shot)] AS predictions
    FROM answers"""


def _voted(t):
    return a.votes(t.answers, "direct", "chain", "few_shot")


@query(
    "lm20_votes",
    f"""SELECT case_id, array_to_string(predictions, '|') AS predictions,
               array_to_string(list_sort(list_distinct(predictions)), '|') AS candidates FROM ({VOTES})""",
)
def _(t):
    return _voted(t).select(
        "case_id", F.array_join("predictions", "|").alias("predictions"), F.array_join("candidates", "|").alias("candidates")
    )


@query(
    "lm20_confidence_prompts",
    f"""SELECT v.case_id, {_filled(fv.PROMPT["confidence"], symptoms=TEXT, candidates="array_to_string(list_sort(list_distinct(predictions)), ', ')")} AS prompt
        FROM ({VOTES}) v JOIN ({CASES}) c ON v.case_id = c.case_id""",
)
def _(t):
    voted = _voted(t).select("case_id", "candidates").join(_cases(t), "case_id")
    return a.with_prompt(voted, "confidence", candidates=F.array_join("candidates", ", ")).select("case_id", "prompt")


@query(
    "lm20_weighed_votes",
    rf"""SELECT case_id, name AS final_prediction, conf AS final_confidence FROM (
           SELECT case_id, name, coalesce(nullif(regexp_extract(confidence, '(?is)\Q' || name || '\E.*?CONFIDENCE:?\s*(\d+)%', 1), '')::INT, 50) AS conf
           FROM (SELECT case_id, confidence, unnest(list_distinct(predictions)) AS name FROM ({VOTES})))
         QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY conf DESC, name) = 1""",
)
def _(t):
    return a.weigh_votes(_voted(t), "confidence").select("case_id", "final_prediction", "final_confidence")


def _vote(t, log):
    """The whole voting job on the test cases, with examples from the training cases."""
    split = cut_lineage(_split(t))
    return ps.vote(
        split.where("is_test").select("case_id", "disease", "symptoms"),
        F.array_join(a.class_names(split, "disease"), ", "),
        a.few_shot_examples(split.where(~F.col("is_test")), 5),
        *_recorded(t, log, "direct", "chain", "few_shot", "confidence"),
    )


CANDIDATES = "list_sort(list_distinct(predictions))"
POLLED = f"""polled AS (SELECT c.*, direct, chain, few_shot, a.confidence, predictions FROM ({SPLIT}) c
                        JOIN answers a ON c.case_id = a.case_id JOIN ({VOTES}) v ON c.case_id = v.case_id WHERE is_test)"""


@query(
    "lm20_vote_job",
    rf"""WITH {POLLED} SELECT case_id, disease, array_to_string(predictions, '|') AS predictions, name AS final_prediction, conf AS final_confidence
        FROM (SELECT *, coalesce(nullif(regexp_extract(confidence, '(?is)\Q' || name || '\E.*?CONFIDENCE:?\s*(\d+)%', 1), '')::INT, 50) AS conf
              FROM (SELECT *, unnest({CANDIDATES}) AS name FROM polled))
        QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY conf DESC, name) = 1""",
)
def _(t):
    """Four passes from cases to the surest answer."""
    out = _vote(t, ps.Transcript())
    return out.select("case_id", "disease", F.array_join("predictions", "|").alias("predictions"), "final_prediction", "final_confidence")


@query(
    "lm20_transcript",
    f"""WITH {POLLED}
        SELECT {_asked("direct", "vote_direct", "direct", classes=CLASSES)} FROM polled
        UNION ALL SELECT {_asked("chain", "vote_chain", "chain", classes=CLASSES)} FROM polled
        UNION ALL SELECT {_asked("few_shot", "vote_few_shot", "few_shot", classes=CLASSES, examples=EXAMPLES)} FROM polled
        UNION ALL SELECT {_asked("confidence", "confidence", "confidence", candidates=f"array_to_string({CANDIDATES}, ', ')")} FROM polled""",
)
def _(t):
    """Prompts and answers of all four passes."""
    log = ps.Transcript()
    _vote(t, log)
    return _transcript(log)


@query(
    "lm21_relevance",
    f"""SELECT disease, symptom, round(count(*) / any_value(total)::DOUBLE, 6) AS relevance
        FROM (SELECT disease, unnest(list_distinct(symptoms)) AS symptom, total
              FROM (SELECT *, count(*) OVER (PARTITION BY disease) AS total FROM ({CASES}))) GROUP BY 1, 2""",
)
def _(t):
    return a.relevance(_cases(t)).withColumn("relevance", F.round("relevance", 6))
