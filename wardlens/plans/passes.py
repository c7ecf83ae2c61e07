"""Jobs of several model passes with a written record of every prompt and answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.plans.answers import Respond, ask_all, votes, weigh_votes, with_prompt
from wardlens.session import cut_lineage, dealt


class Transcript:
    """What was asked and answered in the passes of one job.

    A responder wrapped by :meth:`of` writes its prompts to the shared folder before they are asked and its
    answers after, so a later pass, or a lost executor, neither renders nor asks anything again, and the texts
    that were sent can be read afterwards.
    """

    def __init__(self, key: str = "case_id"):
        self.key = key
        self.passes: list[DataFrame] = []

    def of(self, name: str, respond: Respond) -> Respond:
        """The same responder, on record as a pass of that name."""

        def on_record(prompted: DataFrame) -> DataFrame:
            asked = cut_lineage(prompted.select(self.key, "prompt", "system"))
            answers = respond(asked).select(self.key, "answer")
            answered = cut_lineage(dealt(asked, self.key).join(answers, self.key, "left"))
            self.passes.append(answered.withColumn("pass", F.lit(name)))
            return answered.select(self.key, "answer")

        return on_record

    def table(self) -> DataFrame:
        """All passes so far as (key, pass, prompt, system, answer)."""
        if not self.passes:
            raise ValueError("nothing has been asked yet")
        return reduce(DataFrame.unionByName, self.passes).select(self.key, "pass", "prompt", "system", "answer")


def vote(
    cases: DataFrame, classes: Column, examples: str, direct: Respond, chain: Respond, few_shot: Respond,
    confidence: Respond, key: str = "case_id",
) -> DataFrame:
    """Ask three ways, then ask how sure the model is of each distinct answer; the surest answer wins.

    Returns the columns of the cases with ``predictions``, ``candidates``, ``final_prediction`` and
    ``final_confidence``. A failed answer counts as a prediction of that text; a case without symptoms is asked
    with an empty list. The key must be unique; no cases give no rows.
    """
    voted = cases
    ways = {"direct": (direct, {}), "chain": (chain, {}), "few_shot": (few_shot, {"examples": examples})}
    for name, (respond, places) in ways.items():
        prompted = with_prompt(cases, f"vote_{name}", classes=classes, **places)
        voted = voted.join(respond(prompted).select(key, F.col("answer").alias(f"_{name}")), key, "left")
    settled = cut_lineage(votes(voted, "_direct", "_chain", "_few_shot"))
    rated = ask_all(with_prompt(settled, "confidence", candidates=F.array_join("candidates", ", ")), confidence, key)
    decided = weigh_votes(rated, "answer")
    return decided.select(*cases.columns, "predictions", "candidates", "final_prediction", "final_confidence")
