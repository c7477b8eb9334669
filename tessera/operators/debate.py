"""The review loop: rounds of threats and feedback, the route after a round, and the report at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import llmjson
from .dedup import last_by
from .rounds import checkpointed, ordinals

# The order of severities in a report; all others come last.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Informational")
LIMIT = 2


def route(feedback: DataFrame, count: int, limit: int) -> DataFrame:
    """One row, next: ``hunter`` only below the limit and with a rejection in any round so far."""
    rejected = F.count_if(~F.coalesce(F.col("is_valid"), F.lit(False)))
    return feedback.agg(F.when((F.lit(count) < limit) & (rejected > 0), "hunter").otherwise("mediator").alias("next"), F.count(F.lit(1)).alias("feedbacks"), rejected.alias("rejected"))


def review(propose: Callable[[int, DataFrame | None], DataFrame], validate: Callable[[DataFrame, int], DataFrame], limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None, int]:
    """Run the loop: the last round's threats, all feedback with its round, the number of rounds."""
    feedback, count = None, 0
    while True:
        threats = propose(count, feedback)
        new = checkpointed(validate(threats, count).withColumn("recursion_iteration", F.lit(count)))
        feedback = new if feedback is None else feedback.unionByName(new)
        count += 1
        if route(feedback, count, limit).first()["next"] == "mediator":
            return threats, feedback, count


def rejections(feedback: DataFrame) -> DataFrame:
    """One row, digest: a line for each rejection of any round, in order."""
    line = F.concat(F.lit("- Rejected Threat "), F.col("threat_id"), F.lit(": "), F.coalesce("validation_reason", F.lit("None")))
    f = feedback.filter("NOT coalesce(is_valid, false)").select("ordinal", line.alias("line"))
    return f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("digest"))


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """By threat the last valid feedback of the last round; of all rounds if the last one has none."""
    last = feedback.agg(F.max("recursion_iteration").alias("__last"))
    f = feedback.filter("is_valid").join(F.broadcast(last), F.lit(True))  # one row
    final = F.col("recursion_iteration") == F.col("__last")
    some = f.agg(F.coalesce(F.bool_or(final), F.lit(False)).alias("__some"))
    f = f.join(F.broadcast(some), F.lit(True)).filter(final | ~F.col("__some")).drop("__last", "__some")
    return last_by(f, ["threat_id"], "ordinal")


def valid_threats(threats: DataFrame, feedback: DataFrame) -> DataFrame:
    return threats.join(valid_feedback(feedback).select("threat_id"), "threat_id", "left_semi")


def basic_report(threats: DataFrame, feedback: DataFrame) -> DataFrame:
    f = valid_feedback(feedback).select("threat_id", F.col("adjusted_severity").alias("severity"), "citation_reference")
    return threats.join(f, "threat_id").select(
        "event_id", "threat_id", "category", "target_component", "attack_vector", "severity",
        F.concat(F.lit("Implement controls aligned with "), F.col("citation_reference")).alias("mitigation_strategy"), F.array("citation_reference").alias("citations"))


def final_report(threats: DataFrame, feedback: DataFrame, replies: DataFrame) -> DataFrame:
    """The report that the model's replies (reply) give: its recommendations with defaults, or the basic report where no
    reply holds any. Without a valid threat there are no rows. Columns of the basic report; event_id counts recommendations."""
    basic = basic_report(threats, feedback)
    rich = llmjson.recommendations(replies.select("reply")).drop("reply").withColumn("event_id", F.col("pos").cast("long")).select(*basic.columns)
    some = rich.agg((F.count(F.lit(1)) > 0).alias("__rich"))  # one row
    any_valid = valid_threats(threats, feedback).agg((F.count(F.lit(1)) > 0).alias("__any"))
    rich = rich.join(F.broadcast(any_valid), F.lit(True)).filter("__any").drop("__any")
    return rich.unionByName(basic.join(F.broadcast(some), F.lit(True)).filter("NOT __rich").drop("__rich"))


def severity_rank(c: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(c == s, i).otherwise(rank)
    return rank


def _finding() -> Column:
    return F.concat(
        F.lit("### ["), F.upper("severity"), F.lit("] "), F.col("threat_id"), F.lit(": "), F.col("target_component"), F.lit("\n\n**Category:** "), F.coalesce("category", F.lit("None")),
        F.lit("\n\n**Attack Vector:** "), F.coalesce("attack_vector", F.lit("None")), F.lit("\n\n**Mitigation Strategy:**\n"), F.coalesce("mitigation_strategy", F.lit("None")), F.lit("\n\n"),
        F.when(F.size("citations") > 0, F.concat(F.lit("**References:**\n"), F.array_join(F.transform("citations", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))).otherwise(""),
        F.lit("\n---\n\n"))


def _head(n: Column) -> Column:
    """A report's first lines from the columns of ``llmjson.report_header``; ``n`` counts its findings."""
    summary = F.when(F.col("executive_summary").isNotNull(), F.concat(F.lit("## Executive Summary\n\n"), F.col("executive_summary"), F.lit("\n\n"))).otherwise("")
    count = lambda name, c: F.concat(F.lit(f"- **{name}:** "), F.coalesce(F.col(c), F.lit("0")), F.lit("\n"))
    return F.concat(
        F.lit("# Threat Model Report\n\n"), summary, F.lit("## Threat Summary\n\n- **Total Threats:** "), F.coalesce("total_threats", n.cast("string")), F.lit("\n"),
        count("Critical", "critical_count"), count("High", "high_count"), count("Medium", "medium_count"), F.lit("\n## Detailed Findings\n\n"))


def _header(report: DataFrame, header: DataFrame | None) -> DataFrame:
    """One row: what a reply says of the report, or nulls."""
    none = report.agg(*[F.lit(None).cast("string").alias(f"__{c}") for c in ("executive_summary", *llmjson.COUNTS)], F.count(F.lit(1)).alias("n"))
    if header is None:
        return none.toDF(*[c.removeprefix("__") for c in none.columns])
    one = header.select("executive_summary", *llmjson.COUNTS).limit(1)
    return none.select("n").join(one, F.lit(True), "left")  # one row each


def markdown(report: DataFrame, order: str = "event_id", header: DataFrame | None = None) -> DataFrame:
    """One row, markdown: the report with its findings by severity. ``header`` (of ``llmjson.report_header``) has the summary and
    counts that the reply gave."""
    rows = report.select(severity_rank(F.col("severity")).alias("rank"), F.col(order).alias("o"), _finding().alias("t"))
    all_of = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o", "t"))), lambda x: x["t"]), "").alias("__all"))
    return _header(report, header).join(all_of, F.lit(True)).select(F.concat(_head(F.col("n")), F.col("__all")).alias("markdown"))


def markdown_parts(report: DataFrame, order: str = "event_id", header: DataFrame | None = None, rows: int = 1000) -> DataFrame:
    """(part, start, text): the same text in parts of at most ``rows`` findings; start counts the bytes of all parts before, the head
    being part 0. Findings are sorted in ranges side by side, and no task holds more than a part."""
    d = report.select(severity_rank(F.col("severity")).alias("rank"), F.col(order).alias("o"), _finding().alias("t"))
    d = ordinals(d, "rank", "o").withColumn("part", F.expr(f"1 + ord div {rows}"))
    body = d.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("text"))
    head = _header(report, header).select(F.lit(0).cast("long").alias("part"), _head(F.col("n")).alias("text"))
    return text_parts(head.unionByName(body))


def text_parts(parts: DataFrame) -> DataFrame:
    """With start: the bytes of all parts before. A part's size is a row of two numbers."""
    p = checkpointed(parts)
    before = p.select("part", F.octet_length("text").cast("long").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return p.join(before.drop("n"), "part").select("part", "start", "text")


def rejection_parts(feedback: DataFrame, rows: int = 1000) -> DataFrame:
    """(part, start, text): ``rejections`` in parts; a line ends each but the last."""
    line = F.concat(F.lit("- Rejected Threat "), F.col("threat_id"), F.lit(": "), F.coalesce("validation_reason", F.lit("None")))
    f = ordinals(feedback.filter("NOT coalesce(is_valid, false)").select("ordinal", line.alias("t")), "ordinal")
    t = F.concat(F.when(F.col("ord") > 0, "\n").otherwise(""), F.col("t")).alias("t")
    f = f.select("ord", F.expr(f"ord div {rows}").alias("part"), t)
    return text_parts(f.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("text")))
