"""Refinement of candidates by a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafcut.functions.text import decision_confidence, parse_decision


def context_pages(candidates: DataFrame, pages: DataFrame, reach: int = 3) -> DataFrame:
    """``before`` and ``after``: texts of up to ``reach`` pages before a candidate's page, and from it on.

    A window over the pages, narrowed to 300 characters each; candidates join by equality.
    """
    w = Window.partitionBy("bundle_id").orderBy("page_num")
    short = pages.select("bundle_id", "page_num", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("text"))
    around = short.select("bundle_id", "page_num", F.collect_list("text").over(w.rowsBetween(-reach, -1)).alias("before"), F.collect_list("text").over(w.rowsBetween(0, reach - 1)).alias("after"))
    return candidates.join(around, ["bundle_id", "page_num"], "left")


def decide(rows: DataFrame, response: str = "response") -> DataFrame:
    """``llm_decision, llm_reason, llm_confidence`` from a response column."""
    out = rows.withColumn("_d", parse_decision(F.col(response)))
    out = out.withColumn("llm_decision", F.col("_d.should_split")).withColumn("llm_reason", F.col("_d.reason")).drop("_d")
    return out.withColumn("llm_confidence", F.round(decision_confidence(F.col("llm_decision"), F.col("signal_count"), F.col("llm_reason")), 6))


def approve(rows: DataFrame, min_confidence: float = 0.6, response: str = "response") -> DataFrame:
    """Approved candidates with the model's confidence and a further signal. Without any answer (null) a candidate stays as it is."""
    answered = F.col(response).isNotNull()
    ok = ~answered | (F.col("llm_decision") & (F.col("llm_confidence") >= min_confidence))
    out = rows.where(ok)
    return (
        out.withColumn("confidence", F.when(answered, F.col("llm_confidence")).otherwise(F.col("confidence")))
        .withColumn("signals", F.when(answered, F.array_append("signals", F.concat(F.lit("LLM: "), "llm_reason"))).otherwise(F.col("signals")))
        .withColumn("signal_count", F.col("signal_count") + answered.cast("int"))
    )


def approved_pages(rows: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    ok = rows.where(F.col("llm_decision") & (F.col("llm_confidence") >= min_confidence))
    return ok.groupBy("bundle_id").agg(F.sort_array(F.collect_set("page_num")).alias("pages"))
