"""Scores of answer traces and the release report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expected sections and the number of traces a report covers.
EXPECTED_SECTIONS, REPORT_TRACES = 9, 100


def score_traces(traces: DataFrame) -> DataFrame:
    """Per trace: precision@3, citation validity, completeness, overclaim, failure.

    ``traces``: retrieved_chunk_ids and cited_ids arrays, section_count, citation_valid, compliance_valid,
    latency_ms, ready.
    """
    top = F.array_distinct(F.slice(F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")), 1, 3))
    cited = F.coalesce("cited_ids", F.array().cast("array<string>"))
    hits = F.size(F.array_intersect(top, F.slice(cited, 1, 3)))
    precision = F.when(F.size(top) > 0, hits / F.least(F.size(top), F.lit(3))).otherwise(
        F.when(F.size(cited) == 0, 1.0).otherwise(0.0)
    )
    return traces.withColumns(
        {
            "retrieval_precision_at_3": F.round(precision, 4),
            "citation_validity": F.when(F.coalesce("citation_valid", F.lit(True)), 1.0).otherwise(0.0),
            "answer_completeness": F.round(
                F.least(F.coalesce("section_count", F.lit(0)), F.lit(EXPECTED_SECTIONS)) / EXPECTED_SECTIONS, 4
            ),
            "compliance_overclaim_rate": F.when(F.coalesce("compliance_valid", F.lit(True)), 0.0).otherwise(1.0),
            "latency_ms": F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)),
            "failure": F.when(F.coalesce("ready", F.lit(True)), 0.0).otherwise(1.0),
        }
    )


def recent_traces(traces: DataFrame, created: str = "created_at", tie: str = "trace_id", limit: int = REPORT_TRACES) -> DataFrame:
    return traces.orderBy(F.desc(created), tie).limit(limit)


def release_report(scores: DataFrame) -> DataFrame:
    """Means, inclusive 95th percentile of latency, and the gate; meant for a bounded number of traces."""
    names = ("retrieval_precision_at_3", "citation_validity", "answer_completeness", "compliance_overclaim_rate")
    report = scores.agg(
        F.count(F.lit(1)).alias("trace_count"),
        *[F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias(n) for n in names],
        F.coalesce(F.round(F.percentile("latency_ms", F.lit(0.95)), 4), F.lit(0.0)).alias("latency_p95"),
        F.coalesce(F.round(F.avg("failure"), 4), F.lit(0.0)).alias("failure_rate"),
    )
    passed = (F.col("citation_validity") >= 1.0) & (F.col("compliance_overclaim_rate") <= 0.0)
    return report.withColumn("release_status", F.when(passed, "passed").otherwise("review_required"))
