"""Prompt jobs over a table of cases: build prompts, collect answers, parse and score them.

A job is a chain of table passes. Where answers come from is a parameter: a Python responder that
runs on the executors, or a table of recorded answers.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens import fixed_values as fv
from wardlens.functions.scalars import first_sentence, mixed, non_empty, strip, strip_prefix
from wardlens.operators.joins import lookup
from wardlens.operators.ordered import first_rows
from wardlens.session import cut_lineage

Respond = Callable[[DataFrame], DataFrame]
"""Takes (key, prompt, system) rows and returns (key, answer) rows."""


# ---- cases ------------------------------------------------------------------


def clean_cases(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("case_id", "disease")) -> DataFrame:
    """Wide symptom columns as one array without blanks."""
    return df.select(*keep, non_empty(*columns).alias("symptoms"))


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_distinct("disease").alias("diseases"), F.count(F.lit(1)).alias("samples"))


def class_names(df: DataFrame, column: str) -> Column:
    """Sorted distinct names that go into a prompt, as a one-row subquery; nothing reaches the driver."""
    return df.agg(F.array_sort(F.collect_set(column))).scalar()


def relevance(cases: DataFrame) -> DataFrame:
    """Share of a disease's cases that show a symptom."""
    per_class = cases.groupBy("disease").agg(F.count(F.lit(1)).alias("cases"))
    pairs = (
        cases.select("disease", F.explode(F.array_distinct("symptoms")).alias("symptom"))
        .groupBy("disease", "symptom")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.join(per_class, "disease").select(
        "disease", "symptom", (F.col("n") / F.col("cases")).alias("relevance")
    )


# ---- prompts ----------------------------------------------------------------


def render(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` places of a fixed text with columns or constants."""
    parts = []
    for piece in re.split(r"({\w+})", template):
        name = piece[1:-1]
        if piece.startswith("{") and name in values:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def symptom_text(column: str = "symptoms") -> Column:
    return F.array_join(column, ", ")


def with_prompt(cases: DataFrame, kind: str, system: str | None = None, **values: Column | str) -> DataFrame:
    """Add ``prompt`` and ``system`` of one of the fixed formats."""
    message = fv.SYSTEM.get(system or kind)
    return cases.withColumn("prompt", render(fv.PROMPT[kind], symptoms=symptom_text(), **values)).withColumn(
        "system", render(message, **values) if message else F.lit(None).cast("string")
    )


def few_shot_examples(train: DataFrame, n: int = 5, seed: int = 42) -> str:
    """One training case of each of n classes, chosen by a repeatable hash order.

    Each class is reduced to one row by an aggregate, then n rows reach the driver.
    """
    order = F.struct(mixed("case_id", seed), "case_id")
    picked = train.groupBy("disease").agg(F.min(order).alias("o"), F.min_by("symptoms", order).alias("symptoms"))
    rows = picked.orderBy("o", "disease").limit(n).collect()
    return "\n".join(f"Symptoms: {', '.join(r['symptoms'])}\nDisease: {r['disease']}\n" for r in rows)


def severity_examples(severities: DataFrame, levels: list[int] = fv.SEVERITY_LEVELS, each: int = 3) -> DataFrame:
    """One row: example symptoms of each level, in level and name order."""
    first = first_rows(severities.where(F.col("weight").isin(levels)), ["weight"], ["symptom"], each)
    lines = (
        first.groupBy("weight")
        .agg(F.array_sort(F.collect_list("symptom")).alias("names"))
        .select(
            "weight",
            F.concat(
                F.lit("Symptoms: "), F.array_join("names", ", "), F.lit("\nSeverity: "), F.col("weight").cast("string"), F.lit("/10")
            ).alias("line"),
        )
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("weight", "line"))), lambda s: s["line"])
    return lines.agg(F.array_join(ordered, "\n\n").alias("examples"))


# ---- where answers come from ------------------------------------------------


def python_responder(
    answer: Callable[[str, str | None], str], key: str, parallelism: int | None = None, pause: float = 0.0
) -> Respond:
    """One call per row on the executors; a failed call gives ERROR and the run goes on.

    Answers are written out at once, so a later pass over the table, or a lost executor, does not
    ask again.
    """

    def respond(asked: DataFrame) -> DataFrame:
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers = []
                for prompt, system in zip(batch["prompt"], batch["system"]):
                    try:
                        answers.append(answer(prompt, system).strip())
                        if pause:
                            time.sleep(pause)
                    except Exception:  # noqa: BLE001
                        answers.append(fv.FAILED)
                yield pd.DataFrame({key: batch[key], "answer": answers})

        rows = asked.select(key, "prompt", "system")
        if parallelism:
            rows = rows.repartition(parallelism)
        kind = asked.schema[key].dataType.simpleString()
        return cut_lineage(rows.mapInPandas(ask, f"{key} {kind}, answer string"))

    return respond


STORE = "prompt_key string, answer string, part int"


def prompt_key(prompt: Column | str = "prompt", system: Column | str = "system") -> Column:
    """Digest of a prompt and its system text; a missing system text differs from an empty one."""
    p, s = (F.col(c) if isinstance(c, str) else c for c in (prompt, system))
    return F.sha2(F.encode(F.concat_ws("\x00", F.when(s.isNull(), "0").otherwise("1"), F.coalesce(s, F.lit("")), p), "UTF-8"), 256)


def answer_store(spark: SparkSession, folder: str) -> DataFrame:
    """All calls ever made: (prompt_key, answer, part), ERROR for failed ones; empty for a new folder."""
    spark.createDataFrame([], STORE).write.mode("append").parquet(folder)
    return spark.read.schema(STORE).parquet(folder)


def resumable(responder: Callable[[str], Respond], folder: str, key: str, max_tries: int = 3, parts: int = 4) -> Respond:
    """A responder that keeps its answers in a folder and asks only for what is missing there.

    ``responder`` makes the responder that is asked, given the name of its key column. Equal prompts are asked
    once, however many rows have them. A failed prompt is asked again, in this run or a later one, until it has
    been asked ``max_tries`` times; then it counts as failed. A round appends its answers in several parts, so a
    run that breaks off loses one part at most, and the next run goes on from there. Rows without a prompt fail.
    """

    def calls(spark: SparkSession) -> DataFrame:
        made = answer_store(spark, folder)
        return made.groupBy("prompt_key").agg(
            F.count(F.lit(1)).alias("tries"), F.min(F.when(F.col("answer") != fv.FAILED, F.col("answer"))).alias("answer")
        )

    def respond(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        keyed = cut_lineage(asked.withColumn("prompt_key", prompt_key()))
        wanted = keyed.where(F.col("prompt").isNotNull()).select("prompt_key", "prompt", "system").dropDuplicates(["prompt_key"])
        for _ in range(max_tries):
            settled = calls(spark).where(F.col("answer").isNotNull() | (F.col("tries") >= max_tries))
            missing = wanted.join(settled, "prompt_key", "left_anti")
            missing = cut_lineage(missing.withColumn("part", F.pmod(F.xxhash64("prompt_key"), F.lit(parts)).cast("int")))
            if missing.isEmpty():
                break
            for part in range(parts):
                answers = responder("prompt_key")(missing.where(F.col("part") == part))
                answers.select("prompt_key", "answer", F.lit(part).alias("part")).write.mode("append").parquet(folder)
        known = calls(spark).select("prompt_key", "answer")
        found = keyed.select(key, "prompt_key").join(known, "prompt_key", "left")
        return found.select(key, F.coalesce("answer", F.lit(fv.FAILED)).alias("answer"))

    return respond


def recorded(table: DataFrame, key: str, column: str) -> Respond:
    """Answers looked up by case; a case without a record counts as failed."""

    def respond(asked: DataFrame) -> DataFrame:
        known = table.select(key, F.col(column).alias("answer"))
        return asked.select(key).join(known, key, "left").withColumn("answer", F.coalesce(strip("answer"), F.lit(fv.FAILED)))

    return respond


def next_turn_answers(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows at once, NULL when there is none."""
    ask = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return ask.join(reply, ["conv_id", "turn"], "left")


def ask_all(prompted: DataFrame, respond: Respond, key: str) -> DataFrame:
    return prompted.join(respond(prompted), key, "left")


# ---- reading answers --------------------------------------------------------


def clean_answer(answer: Column | str) -> Column:
    """First sentence without the usual opening phrases."""
    out = first_sentence(answer)
    for prefix in fv.ANSWER_PREFIXES:
        out = strip_prefix(out, prefix)
    return out


def score_answers(df: DataFrame, actual: str, answer: str) -> DataFrame:
    cleaned = clean_answer(answer)
    return df.withColumn("predicted", cleaned).withColumn(
        "correct", F.lower("predicted") == F.lower(F.col(actual))
    )


def found(text: Column | str, pattern: str, fallback: Column | str) -> Column:
    """First group of a pattern, trimmed, or the fallback when nothing matches."""
    c = F.col(text) if isinstance(text, str) else text
    otherwise = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).otherwise(otherwise)


def final_answer(text: Column | str) -> Column:
    return found(text, fv.FINAL_PATTERN, fv.NO_ANSWER)


def listed_names(text: Column | str) -> Column:
    """Names on numbered lines, in order."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(c, "\n"), lambda s: s.rlike(fv.LIST_LINE_PATTERN))
    return F.transform(lines, lambda s: strip(F.regexp_extract(s, fv.LIST_LINE_PATTERN, 1)))


def list_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per listed name."""
    return df.select(key, F.posexplode(listed_names(text)).alias("pos", "name"))


def first_ranked(text: Column | str, candidates: Column) -> Column:
    """Top name of a ranking text, else the first candidate, else Unknown."""
    return found(text, fv.RANKING_PATTERN, F.coalesce(F.get(candidates, F.lit(0)), F.lit(fv.UNKNOWN)))


# ---- two-pass jobs ----------------------------------------------------------


def narrow_down(
    cases: DataFrame,
    names: Column,
    list_answers: Respond,
    rank_answers: Respond,
    key: str = "case_id",
    how_many: int = 7,
    branches: int = 3,
) -> DataFrame:
    """List likely classes, then rank the first few; one listed class needs no second pass."""
    first = ask_all(
        with_prompt(cases, "list", classes=F.array_join(names, ", "), how_many=str(how_many)), list_answers, key
    ).select(*cases.columns, F.col("answer").alias("_first"), listed_names("answer").alias("potential"))
    open_cases = with_prompt(
        first.where(F.size("potential") > 1), "rank", candidates=F.array_join(F.slice("potential", 1, branches), ", ")
    )
    second = rank_answers(open_cases).withColumnRenamed("answer", "_second")
    decided = first.join(second, key, "left")
    return decided.select(
        *cases.columns,
        "potential",
        F.when(F.col("_first") == fv.FAILED, fv.FAILED)
        .when(F.size("potential") == 0, fv.NO_ANSWER)
        .when(F.size("potential") == 1, F.get("potential", F.lit(0)))
        .when(F.col("_second") == fv.FAILED, fv.FAILED)
        .otherwise(first_ranked("_second", F.slice("potential", 1, branches)))
        .alias("prediction"),
    )


# ---- categories -------------------------------------------------------------


def fixed_members(spark: SparkSession) -> DataFrame:
    """The fixed category list as (category, pos, disease)."""
    rows = [(c, d) for c, names in fv.DISEASE_CATEGORIES.items() for d in names]
    return spark.createDataFrame(
        [(c, i, d) for i, (c, d) in enumerate(rows)], "category string, pos long, disease string"
    )


def category_map(members: DataFrame, cases: DataFrame) -> DataFrame:
    """Category of every known disease: the last listing wins, unlisted diseases are Other.

    One small row per disease, used several times by the jobs, so it is written out once.
    """
    last = members.groupBy("disease").agg(F.max_by("category", "pos").alias("category"))
    seen = cases.select("disease").where(F.col("disease").isNotNull()).distinct()
    others = seen.join(last, "disease", "left_anti").withColumn("category", F.lit("Other"))
    return cut_lineage(last.unionByName(others))


def category_counts(mapping: DataFrame, cases: DataFrame) -> DataFrame:
    """Diseases of the case table per category."""
    seen = cases.select("disease").distinct()
    return mapping.join(seen, "disease", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("diseases"))


def all_members(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Listed members plus the unlisted diseases under Other, after the listed ones, by name."""
    listed = members.select("category", "disease", F.lit(0).alias("late"), "pos", F.lit("").alias("name"))
    extra = (
        mapping.where(F.col("category") == "Other")
        .join(members, "disease", "left_anti")
        .select("category", "disease", F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("pos"), F.col("disease").alias("name"))
    )
    return listed.unionByName(extra)


def candidate_sets(members: DataFrame, mapping: DataFrame, others: int = 2) -> DataFrame:
    """Per category: its members and the first few of every other category, sorted, without repeats.

    The first few of the category itself are members anyway, so one shared list serves all rows.
    """
    everyone = cut_lineage(all_members(members, mapping))
    opening = (
        first_rows(everyone, ["category"], ["late", "pos", "name"], others)
        .agg(F.collect_set("disease"))
        .scalar()
    )
    return cut_lineage(
        everyone.groupBy("category")
        .agg(F.collect_set("disease").alias("own"), F.count(F.lit(1)).alias("size"))
        .withColumn("opening", opening)
        .select("category", F.array_sort(F.array_union("own", "opening")).alias("candidates"), "size")
    )


def settle_category(answers: DataFrame, sets: DataFrame, column: str = "answer") -> DataFrame:
    """Attach the candidate set of the answered category; an unknown one becomes the largest."""
    largest = sets.agg(F.max_by("category", F.struct("size", "category"))).scalar()
    known = sets.select(F.col("category").alias(column), F.lit(True).alias("_known"))
    return (
        answers.join(known, column, "left")
        .withColumn("category", F.when(F.col("_known"), F.col(column)).otherwise(largest))
        .drop("_known")
        .join(sets.select("category", "candidates"), "category")
    )


def by_category(
    cases: DataFrame, members: DataFrame, category_answers: Respond, disease_answers: Respond, key: str = "case_id"
) -> DataFrame:
    """Predict the category, then the disease among that category's candidates."""
    mapping = category_map(members, cases)
    names = F.array_join(class_names(mapping, "category"), ", ")
    first = ask_all(with_prompt(cases, "category", categories=names), category_answers, key)
    settled = settle_category(first.drop("prompt", "system"), candidate_sets(members, mapping)).drop("answer")
    second = with_prompt(
        settled, "within_category", category=F.col("category"), candidates=F.array_join("candidates", ", ")
    )
    return ask_all(second, disease_answers, key).select(
        key, "disease", F.col("category").alias("predicted_category"), F.col("answer").alias("predicted")
    )


# ---- severity ---------------------------------------------------------------


def baseline_severity(cases: DataFrame, severities: DataFrame, key: str = "case_id") -> DataFrame:
    """Mean known severity of a case's symptoms, unknown ones 0, an empty list 0."""
    rows = cases.select(key, F.explode("symptoms").alias("symptom"))
    weighted = lookup(rows, severities, "symptom", "weight", 0)
    means = weighted.groupBy(key).agg(F.avg("weight").alias("baseline"))
    return cases.select(key).join(means, key, "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))


def urgency(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    out = F.lit(None).cast("string")
    for lo, hi, text in reversed(fv.URGENCY):
        out = F.when(s.between(lo, hi), text).otherwise(out)
    return out


def severity_scores(answers: DataFrame, baselines: DataFrame, key: str = "case_id") -> DataFrame:
    """Score named in the answer, else (also when its number is too long) the rounded baseline, half to even."""
    stated = F.regexp_extract("answer", fv.SEVERITY_PATTERN, 1).try_cast("int")
    score = F.coalesce(stated, F.bround("baseline").cast("int"))
    return (
        answers.join(baselines, key)
        .withColumn("severity", score)
        .withColumn("urgency", urgency("severity"))
    )


# ---- treatment --------------------------------------------------------------


def precaution_lists(precautions: DataFrame, columns: list[str]) -> DataFrame:
    """Non-empty precautions per disease, the last row of a disease wins."""
    return precautions.groupBy("disease").agg(
        F.max_by(non_empty(*columns), "row_id").alias("precautions"), F.min("row_id").alias("first_row")
    )


def treatment_context(
    cases: DataFrame, lists: DataFrame, mapping: DataFrame, similar: int = 3, key: str = "case_id"
) -> DataFrame:
    """Known precautions of the disease and examples from other diseases of its category.

    One more example than needed is kept per category, so a case can leave out its own disease.
    """
    categorised = lookup(lists, mapping, "disease", "category", "Other")
    line = F.concat(
        F.lit("Disease: "), F.col("disease"), F.lit("\nPrecautions: "), F.array_join("precautions", "; ")
    )
    examples = (
        first_rows(categorised, ["category"], ["first_row"], similar + 1)
        .groupBy("category")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "disease", line.alias("line")))).alias("examples"))
    )
    placed = lookup(cases, mapping, "disease", "category", "Other")
    joined = placed.join(lists.select("disease", "precautions"), "disease", "left").join(examples, "category", "left")
    others = F.filter("examples", lambda e: e["disease"] != F.col("disease"))
    text = F.transform(F.slice(others, 1, similar), lambda e: e["line"])
    return joined.select(
        key,
        "disease",
        "symptoms",
        "category",
        F.when(F.size("precautions") > 0, F.array_join("precautions", "; ")).otherwise(fv.NO_PRECAUTIONS).alias("known"),
        F.coalesce(F.array_join(text, "\n\n"), F.lit("")).alias("context"),
    )


def treatment_prompts(context: DataFrame) -> DataFrame:
    return with_prompt(
        context, "treatment", disease=F.col("disease"), category=F.col("category"), known=F.col("known"), context=F.col("context")
    )


# ---- three votes ------------------------------------------------------------


def votes(df: DataFrame, direct: str, chain: str, few_shot: str) -> DataFrame:
    """Three answers per case and their distinct candidates, sorted; the chain falls back to direct."""
    one, three = strip(direct), strip(few_shot)
    two = found(chain, fv.DIAGNOSIS_PATTERN, one)
    return df.withColumn("predictions", F.array(one, two, three)).withColumn(
        "candidates", F.array_sort(F.array_distinct("predictions"))
    )


def confidence_of(name: Column, text: Column) -> Column:
    """Confidence stated after a name in a text, in any case; 50 when none is or its number is too long."""
    at = F.position(F.lower(name), F.lower(text))
    value = F.regexp_extract(F.substring(text, at + F.length(name), F.length(text)), "(?is)^" + fv.CONFIDENCE_TAIL, 1)
    return F.coalesce(F.when(at > 0, value.try_cast("int")), F.lit(fv.DEFAULT_CONFIDENCE))


def weigh_votes(voted: DataFrame, confidence_text: str) -> DataFrame:
    """Candidate with the highest confidence; of equals, the first by name."""
    rated = F.transform(
        "candidates",
        lambda c: F.struct((-confidence_of(c, F.col(confidence_text))).alias("minus"), c.alias("name")),
    )
    best = F.array_min(rated)
    return voted.withColumn("final_prediction", best["name"]).withColumn("final_confidence", -best["minus"])
