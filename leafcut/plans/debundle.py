"""The whole chain: pages with text and vectors to named segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.functions.text import numbered_name, with_plain_name
from leafcut.operators.detect import combine, detect, detect_all, measures
from leafcut.operators.segment import accept, segments, unique_names

KINDS = ("number", "header_footer", "blank")


@dataclass(frozen=True)
class Parameters:
    accept: float = 0.5
    eps: float = 0.5
    min_samples: int = 1
    low: float = 0.3
    mid: float = 0.5
    prefix: str = "document"


def debundle(pages: DataFrame, embedded: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """``bundle_id, segment_idx, start_page, end_page, page_count, confidence, suggested_name, output_filename``.

    ``pages``: ``bundle_id, page_num, text``, or in place of ``text`` what ``measures`` and ``with_plain_name`` take of it
    already; ``embedded``: the same pages with ``embedding``, for the two vector detectors. Texts are not shuffled.
    """
    if "text" in pages.columns:
        pages = with_plain_name(pages).select("bundle_id", "page_num", *measures(KINDS), "plain_name")
    if embedded is None:
        signals = detect(pages)
    else:
        signals = detect(pages, KINDS).unionByName(detect_vectors(embedded, p))
    totals = pages.groupBy("bundle_id").agg(F.count("*").cast("int").alias("total"))
    segs = segments(totals, accept(combine(signals), p.accept))
    first = pages.select("bundle_id", F.col("page_num").alias("start_page"), "plain_name")
    out = segs.join(first, ["bundle_id", "start_page"], "left")
    out = out.withColumn("suggested_name", F.coalesce("plain_name", numbered_name(F.col("segment_idx") + 1, p.prefix)))
    return unique_names(out.select("bundle_id", "segment_idx", "start_page", "end_page", "page_count", "confidence", "suggested_name"))


def detect_vectors(embedded: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    from leafcut.operators.detect import cluster_boundaries
    from leafcut.operators.vectors import cluster_labels

    return detect(embedded, ("semantic",), low=p.low, mid=p.mid).unionByName(cluster_boundaries(cluster_labels(embedded, p.eps, p.min_samples)))


__all__ = ["Parameters", "debundle", "detect_all", "detect_vectors"]
