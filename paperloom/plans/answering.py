"""Questions to model requests, and replies to grounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import CONTEXT_CHARS, RELEVANCE_FLOOR
from ..operators.bookkeeping import cache_key, plan_cache
from ..operators.evidence import equal_shares, pack, screen
from ..operators.grounding import ground_answers, ground_comparison, ground_gaps, ground_novelty, ground_reviews
from ..operators.replies import parse_replies
from ..operators.retrieval import (
    compared_papers_gate, drop_near_identical, evidence_gate, evidence_strength, search,
)


def prepare_requests(
    questions: DataFrame, chunks: DataFrame, papers: DataFrame, stored: DataFrame, *, budget: int = CONTEXT_CHARS,
    floor: float = RELEVANCE_FLOOR, model: str | None = None, cache: bool = True,
) -> DataFrame:
    """One row per question: gate, cache plan and, where a model is to be called, the context.

    ``questions``: query_id, user_id, task, text, embedding, top_k, sections,
    single_paper, refresh. ``chunks`` carry their content.
    """
    hits = drop_near_identical(search(chunks, papers, questions))
    gate = evidence_gate(
        evidence_strength(questions, hits, floor).join(questions.select("query_id", "task", "single_paper"), "query_id")
    )
    # At most top_k ids per question.
    ids = hits.groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("evidence_ids"))
    keyed = (
        questions.select("query_id", "user_id", "text", "refresh")
        .join(gate, "query_id")
        .join(ids, "query_id", "left")
        .withColumn("cache_key", cache_key(F.col("task"), F.lit(model).cast("string"), F.col("text"), F.col("evidence_ids")))
    )
    open_ones = keyed.filter("gate = 'OK'").select(F.col("query_id").alias("request_id"), "user_id", "cache_key", "refresh")
    plan = plan_cache(open_ones, stored, enabled=cache).select(F.col("request_id").alias("query_id"), "cache_plan", "stored_id", "calls_model")
    calls = plan.filter("calls_model").select("query_id")
    contexts = pack(hits.join(calls, "query_id", "left_semi"), budget).select("query_id", "context")
    return keyed.drop("text").join(plan, "query_id", "left").join(contexts, "query_id", "left")


def prepare_comparisons(asked: DataFrame, hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """One row per comparison and paper with its context, or the refusal.

    ``asked``: query_id, paper_id of the papers to compare; ``hits``: their
    passages. Each paper asked for gets an equal part of the budget; a comparison
    with a paper that has no passage is refused (gate EMPTY, no contexts).
    """
    gate = compared_papers_gate(asked, hits)
    open_ones = gate.filter("gate = 'OK'").select("query_id")
    shared = equal_shares(hits.join(open_ones, "query_id", "left_semi"), budget, asked)
    contexts = pack(shared, keys=("query_id", "paper_id")).select("query_id", "paper_id", "context")
    return asked.select("query_id", "paper_id").distinct().join(gate, "query_id").join(
        contexts, ["query_id", "paper_id"], "left")


def check_replies(replies: DataFrame, evidence: DataFrame, task: str, strength: DataFrame | None = None,
                  asked: DataFrame | None = None) -> DataFrame:
    """Grounded results of one task's replies.

    ``replies``: request_id, text and the counts the task needs. ``evidence``:
    request_id, chunk_id, paper_id, paper_title, content. ``asked``: request_id,
    paper_id, title of the papers to compare.
    """
    parsed = parse_replies(replies, task)
    if task == "qa":
        return ground_answers(parsed, screen(evidence))
    # These screen what a reply quotes and nothing else.
    if task == "research_gap":
        return ground_gaps(parsed, evidence)
    if task == "novelty":
        return ground_novelty(parsed, evidence, strength)
    if task == "comparison":
        return ground_comparison(parsed, asked)
    if task == "literature_review":
        return ground_reviews(parsed, screen(evidence))
    return parsed.filter("valid")
