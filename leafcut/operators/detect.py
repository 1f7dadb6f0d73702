"""Detectors of document starts, and how their signals are combined.

A detector gives rows ``bundle_id, page_num, confidence, reason, det_ord``. All window detectors share one window, so
Spark plans one exchange and one sort; pages are narrowed to what the detectors compare before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcut.functions.text import blank_measure, header_footer, page_number
from leafcut.operators.vectors import cluster_labels, dot

MEASURES = {"num", "len_header", "sum_header", "len_footer", "sum_footer", "stripped"}
ORDER = {"number": 0, "header_footer": 1, "blank": 2, "semantic": 3, "cluster": 4}


def pages_in_order():
    return Window.partitionBy("bundle_id").orderBy("page_num")


def measures(kinds: tuple[str, ...]) -> list[Column]:
    """What the detectors compare of a page's text. Taken before pages are numbered or shuffled, texts stay where they are."""
    header, footer = header_footer(F.col("text"))
    own = {
        "number": [page_number(F.col("text")).alias("num")],
        "header_footer": [f(c).alias(f"{n}_{k}") for k, c in (("header", header), ("footer", footer)) for n, f in (("len", F.length), ("sum", F.md5))],
        "blank": [blank_measure(F.col("text")).alias("stripped")],
    }
    return [c for k in kinds for c in own.get(k, [])]


def narrow(pages: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """What the detectors need of each page, without its text; pages without a ``text`` have their measures already."""
    own = measures(kinds) if "text" in pages.columns else [F.col(c) for c in pages.columns if c in MEASURES]
    return pages.select("bundle_id", "page_num", *own, *(["embedding"] if "semantic" in kinds else []))


def _signal(kind: str, confidence: Column, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(confidence.isNotNull(), F.struct(confidence.alias("confidence"), reason.alias("reason"), F.lit(ORDER[kind]).alias("det_ord")))


def number_signal() -> Column:
    cur, prev = F.col("num"), F.lag("num").over(pages_in_order())
    reset, jump = (prev >= 2) & (cur == 1), cur < prev - 5
    what = F.when(reset, "Page number reset: ").otherwise("Page number jump backward: ")
    return _signal("number", F.when(reset, 0.9).when(jump, 0.7), F.concat(what, prev.cast("string"), F.lit(" -> "), cur.cast("string")))


def header_footer_signal() -> Column:
    def changed(k: str) -> Column:
        n, was = F.col(f"len_{k}"), F.lag(f"len_{k}").over(pages_in_order())
        return F.coalesce((n >= 3) & (was >= 3) & (F.col(f"sum_{k}") != F.lag(f"sum_{k}").over(pages_in_order())), F.lit(False))

    head, foot = changed("header"), changed("footer")
    reason = F.when(head & foot, "Header and footer changed").when(head, "Header changed").otherwise("Footer changed")
    return _signal("header_footer", F.when(head & foot, 0.6).when(head | foot, 0.4), reason)


def blank_signal() -> Column:
    was = F.lag("stripped").over(pages_in_order())
    return _signal("blank", F.when((was < 10) & (F.col("stripped") > 30), 0.85), F.concat(F.lit("Blank page before, length "), was.cast("string")))


def semantic_signal(low: float = 0.3, mid: float = 0.5) -> Column:
    similarity = dot(F.lag("embedding").over(pages_in_order()), F.col("embedding"))
    return _signal("semantic", F.when(similarity < low, 0.7).when(similarity < mid, 0.5), F.when(similarity < low, "Low similarity to the page before").otherwise("Reduced similarity to the page before"))


WINDOWED: dict[str, Callable[[], Column]] = {"number": number_signal, "header_footer": header_footer_signal, "blank": blank_signal, "semantic": semantic_signal}


def detect(pages: DataFrame, kinds: tuple[str, ...] = ("number", "header_footer", "blank"), **options) -> DataFrame:
    """Signals of the window detectors named, in one pass. options: ``low``, ``mid`` of the semantic detector."""
    signals = [WINDOWED[k](**options) if k == "semantic" else WINDOWED[k]() for k in kinds]
    wide = narrow(pages, kinds).select("bundle_id", "page_num", F.array_compact(F.array(*signals)).alias("s"))
    return wide.select("bundle_id", "page_num", F.explode("s").alias("s")).select("bundle_id", "page_num", "s.*")


def cluster_boundaries(labels: DataFrame) -> DataFrame:
    """A signal wherever the cluster changes; from noise to noise it does not."""
    was = F.lag("label").over(pages_in_order())
    out = labels.select("bundle_id", "page_num", F.when(was != F.col("label"), 0.6).alias("confidence"))
    return out.where("confidence is not null").select("bundle_id", "page_num", "confidence", F.lit("Cluster changed").alias("reason"), F.lit(ORDER["cluster"]).alias("det_ord"))


def detect_all(pages: DataFrame, eps: float = 0.5, min_samples: int = 1, extra: tuple[Callable[[DataFrame], DataFrame], ...] = (), **options) -> DataFrame:
    """All five detectors, and any more of one's own."""
    out = detect(pages, ("number", "header_footer", "blank", "semantic"), **options).unionByName(cluster_boundaries(cluster_labels(pages, eps, min_samples)))
    for own in extra:
        out = out.unionByName(own(pages))
    return out


def combine(signals: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """A candidate per page: the greatest confidence, 0.1 more for each further signal (0.2 at most, 1.0 in all)."""
    grouped = signals.groupBy("bundle_id", "page_num").agg(F.count("*").alias("signal_count"), F.max("confidence").alias("most"), F.sort_array(F.collect_list(F.struct("det_ord", "reason"))).alias("all"))
    bonus = F.least(F.lit(0.2), (F.col("signal_count") - 1) * F.lit(0.1))
    out = grouped.select("bundle_id", "page_num", F.round(F.least(F.lit(1.0), F.col("most") + bonus), 6).alias("confidence"), F.col("all.reason").alias("signals"), "signal_count")
    return out.where(F.col("confidence") >= min_confidence).withColumn("method", F.when(F.col("confidence") >= 0.8, "heuristic").otherwise("clustering"))
