"""Validation of all threats at once: what the knowledge base says to each, the evaluator's reply, and defaults where either fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import llmjson
from ..functions.text import budget
from ..sources.plugins import map_text
from .retrieve import contexts, hybrid_many, nearest_within

# What stands in for a context, a reason and a citation that are not to be had.
NO_CONTEXT = "(No knowledge base results available)"
GUIDELINES = 1500
FAILED, MANUAL = "LLM evaluation failed, assuming valid: ", "Manual review required"


def with_context(threats: DataFrame, nodes: DataFrame, k: int = 5, entities: DataFrame | None = None, edges: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    """``threats`` (event_id, embedding of its query, ...) with kb_context: the texts of the k nearest nodes (id, embedding,
    text_content), a blank line between, and then the edges around the nearest entities, where these are given. Where the
    threats have document_id, as the nodes then have, only that document is searched. ``chars`` cuts the context, and each
    text before it is sent anywhere. A threat without a vector or without nodes gets a stand-in."""
    own = "document_id" in threats.columns
    here = F.col("document_id") if own else F.lit("")
    q = threats.select(F.col("event_id").alias("qid"), here.alias("document_id"), "embedding")
    n = nodes.select("id", here.alias("document_id"), "embedding", "text_content")
    if entities is not None and edges is not None:
        found = hybrid_many(q, n, entities, edges, k, chars=chars)
    else:
        text = F.substring("text_content", 1, chars) if chars else F.col("text_content")
        found = nearest_within(q, n, k).join(n.select("id", text.alias("text")), "id").select("qid", F.col("rk").alias("ord"), "text")
    text = contexts(found, chars).select(F.col("qid").alias("event_id"), F.col("context").alias("kb_context"))
    return threats.join(text, "event_id", "left").withColumn("kb_context", F.coalesce("kb_context", F.lit(NO_CONTEXT)))


def prompts(threats: DataFrame, context: str, iteration: int) -> DataFrame:
    """With prompt: what the evaluator reads of a threat, in budgets of 1,000 characters of context and 1,500 of guidelines."""
    fields = [("ID", "threat_id"), ("Category", "category"), ("Target", "target_component"), ("Attack vector", "attack_vector")]
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\n")) for name, c in fields]
    return threats.withColumn("prompt", F.concat(
        F.lit(f"Round {iteration}. Is this threat real, and how severe?\n"), *parts, F.lit("\nArchitecture:\n" + context[:1000] + "\n\nGuidelines:\n"), budget(F.col("kb_context"), GUIDELINES)))


def validate(threats: DataFrame, nodes: DataFrame, call: Callable[[list[str]], list], context: str = "", iteration: int = 0, k: int = 5,
             entities: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Feedback for every threat: event_id, threat_id, is_valid, validation_reason, adjusted_severity, citation_reference,
    recursion_iteration. Where ``call`` raises, or gives a null reply, the evaluation of just that threat has failed: it counts
    as valid, for review by hand, with the first 100 characters of the error. A reply that nothing can be read from gives
    no row."""
    p = prompts(with_context(threats, nodes, k, entities, edges, GUIDELINES), context, iteration).select("event_id", "threat_id", "prompt")
    r = map_text(p, "prompt", "reply", "string", call, "error").drop("prompt")
    read = llmjson.feedback(r.filter("reply IS NOT NULL").drop("error"))
    lost = r.filter("reply IS NULL").select(
        "event_id", "threat_id", F.lit(None).cast("string").alias("reply"), F.lit(True).alias("is_valid"), F.concat(F.lit(FAILED), F.coalesce(F.substring("error", 1, 100), F.lit("no reply"))).alias("validation_reason"),
        F.lit("High").alias("adjusted_severity"), F.lit(MANUAL).alias("citation_reference"))
    return read.unionByName(lost).drop("reply").withColumn("recursion_iteration", F.lit(iteration))
