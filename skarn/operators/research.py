"""Plan, retrieve and judge: research with injected models, over a batch of questions.

A planner is any callable from a question to a Plan; a judge is a column of verdicts. Without one nothing is made up:
``no_planner`` raises ``PlannerUnavailable``.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.operators.fusion import first_seen, judged
from skarn.plans.stage import write_stage

MOST_QUERIES, MOST_JUDGED, FREE_RANKS, REASON_CHARS = 3, 12, 3, 200
PROFILE_NAMES = ("general", "servicenow", "personal")


class PlannerUnavailable(RuntimeError):
    """No planner was given or it could not be reached."""


@dataclass(frozen=True)
class Plan:
    queries: tuple[str, ...]
    profile: str
    reason: str


#: Characters of the evidence that a judge is shown.
EXCERPT_CHARS = 1_200


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat-completions server as planner or judge: called with a prompt it gives the answer's text. Any failure to get one is ``PlannerUnavailable``."""

    url: str
    model: str
    max_tokens: int = 400
    timeout: float = 60.0

    def _get(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except (OSError, ValueError) as error:
            raise PlannerUnavailable(f"{self.url}: {error}") from error

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": self.max_tokens}
        answer = self._get("/chat/completions", body)
        try:
            return answer["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as error:
            raise PlannerUnavailable(f"{self.url}: an answer without content") from error

    def reachable(self) -> bool:
        """Whether the server has the model, a tag behind its name aside."""
        try:
            listed = self._get("/models").get("data") or []
        except PlannerUnavailable:
            return False
        names = [str(m.get("id")) for m in listed if isinstance(m, dict)]
        return any(n == self.model or n.startswith(self.model + ":") for n in names)


def no_planner(question: str) -> str:
    raise PlannerUnavailable("no planner was given")


def lenient_json(text: str) -> dict:
    """The JSON object in a model's answer: bare, in a code fence, or between the outermost braces; ValueError if there is none."""
    bare = re.sub(r"\A\s*```[a-zA-Z]*\s*|\s*```\s*\Z", "", text)
    for candidate in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    raise ValueError("the answer holds no JSON object")


def plan(question: str, ask: Callable[[str], str] = no_planner) -> Plan:
    """Ask the planner; blanks are dropped, no query left means the question itself, at most three are used, an unknown profile is general."""
    answer = lenient_json(ask(question))
    queries = [str(q).strip() for q in answer.get("queries") or [] if str(q).strip()]
    profile = answer.get("profile") or answer.get("agent")
    return Plan(tuple(queries[:MOST_QUERIES] or [question]), profile if profile in PROFILE_NAMES else "general", str(answer.get("reason") or "")[:REASON_CHARS])


def plans_of(questions: DataFrame, ask: Callable[[str], str] = no_planner) -> DataFrame:
    """(question_id, query_idx, query_id, text, profile, reason): the sub-queries planned for each question (query_id, text). The planner is asked on the executors, once a question; an answer that holds no plan, or no planner, is an error."""
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, text in zip(pdf["query_id"], pdf["text"]):
                made = plan(text or "", ask)
                rows += [(qid, i, f"{qid}#{i}", q, made.profile, made.reason) for i, q in enumerate(made.queries)]
            yield pd.DataFrame(rows, columns=["question_id", "query_idx", "query_id", "text", "profile", "reason"])

    return questions.select("query_id", "text").mapInPandas(run, f"question_id {kind}, query_idx int, query_id string, text string, profile string, reason string")


def is_relevant(answer: Column) -> Column:
    """A judge's answer in words as a verdict: anything that does not begin with "no" is a yes; no answer is none."""
    return ~F.startswith(F.lower(F.ltrim(answer)), F.lit("no"))


def verdicts(pool: DataFrame, questions: DataFrame, judge: Callable[[str, str], str]) -> DataFrame:
    """The pool (question_id, rank, text, ...) with ``relevant``: what the judge says of the question and the first EXCERPT_CHARS of each piece of evidence that it may be asked about; null for the others."""
    asked = pool.join(questions.select(F.col("query_id").alias("question_id"), F.col("text").alias("_question")), "question_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wanted = (pdf["rank"] > FREE_RANKS) & (pdf["rank"] <= FREE_RANKS + MOST_JUDGED)
            pdf["_answer"] = [judge(q or "", (t or "")[:EXCERPT_CHARS]) if w else None for q, t, w in zip(pdf["_question"], pdf["text"], wanted)]
            yield pdf.drop(columns="_question")

    schema = pool.select(*[c for c in asked.columns if c != "_question"]).schema.add("_answer", "string")
    return asked.mapInPandas(run, schema).withColumn("relevant", is_relevant(F.col("_answer"))).drop("_answer")


def research(questions: DataFrame, ask: Callable[[str], str], retrieve: Callable[[DataFrame, str], DataFrame], judge: Callable[[str, str], str] | None, budget: int = 6) -> DataFrame:
    """The whole loop for a batch of questions (query_id, text): plan, retrieve, pool, judge, cut.

    ``retrieve`` gives, for sub-queries (query_id, text) and a profile, hits (query_id, doc_id, rank, score, text) at
    least max(3 budget, budget + 4) deep. Returns (question_id, rank, doc_id, score, profile, n_judged), at most
    ``budget`` rows a question. Without a judge the first ``budget`` of the pool are kept and n_judged is 0.
    """
    planned = write_stage(plans_of(questions, ask), "plans")
    arms = [retrieve(planned.where(F.col("profile") == name).select("query_id", "text"), name).select("query_id", "doc_id", "rank", "score", "text") for name in PROFILE_NAMES]
    hits = reduce(DataFrame.unionByName, arms).join(planned.select("query_id", "question_id", "query_idx", "profile"), "query_id")
    pool = evidence_pool(hits.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", budget)
    if judge is None:
        kept = pool.where(F.col("rank") <= budget).withColumn("n_judged", F.lit(0).cast("long"))
    else:
        # asked once, however often the verdicts are read
        kept = brief(write_stage(verdicts(pool, questions, judge), "judged"), F.col("relevant"), budget)
    return kept.select("question_id", "rank", "doc_id", "score", "profile", "n_judged")


def evidence_pool(hits: DataFrame, parent: str, budget: int) -> DataFrame:
    """The pool of each question from the hits (question_id, query_idx, rank, score, parent, ...) of its sub-queries.

    Each sub-query gives at most max(3 budget, budget + 4) hits; later repeats of a parent are dropped; what is left
    is ranked by score, ties in the order found.
    """
    pool = first_seen(hits.where(F.col("rank") <= max(3 * budget, budget + 4)), parent)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "query_idx", "rank")
    return pool.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def brief(pool: DataFrame, verdict: Column, budget: int) -> DataFrame:
    """The evidence kept for each question: judged in rank order, at most ``budget`` rows. Pools of up to three rows pass unjudged."""
    kept = judged(pool, verdict, budget, FREE_RANKS, MOST_JUDGED)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("rank") <= budget)


def words_per_item(budget: int, most_words: int = 900, most_items: int = 6, least: int = 40) -> int:
    """Words that each item of a brief may have."""
    return max(least, most_words // max(1, min(budget, most_items)))
