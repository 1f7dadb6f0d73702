"""Quality of a text layer: metrics, confidence, coverage, validity, reasons, and whether OCR text replaces it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcut.functions.text import COMMON_WORDS, WS, ascii_words, py_strip, text_of


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 100
    min_printable: float = 0.85
    min_alphanumeric: float = 0.60
    max_whitespace: float = 0.40
    min_words: int = 10
    min_word_length: float = 2.0
    max_word_length: float = 20.0
    min_confidence: float = 0.65
    strict_confidence: float = 0.80
    min_density: float = 0.001
    check_coverage: bool = True
    min_coverage_confidence: float = 0.50
    min_text_coverage: float = 0.70
    max_uncovered: float = 0.30


METRICS = "total_chars printable_ratio alphanumeric_ratio whitespace_ratio word_count avg_word_length common_words sentence_markers unicode_errors text_density".split()


def _metrics_of(t: Column, words: Column, area: Column) -> dict[str, Column]:
    n, count = F.length(t), F.size(words)
    some = F.greatest(n, F.lit(1))
    # White space is printable here, though much of it is of category C or Z.
    hidden = F.regexp_count(t, F.lit(r"[\p{C}&&[^" + WS[1:] + "]"))
    # What most characters are is counted by what is left without runs of the others.
    alphanumeric = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    return {
        "total_chars": n,
        "printable_ratio": F.when(n > 0, (n - hidden) / some).otherwise(0.0),
        "alphanumeric_ratio": F.when(n > 0, alphanumeric / some).otherwise(0.0),
        "whitespace_ratio": F.when(n > 0, F.regexp_count(t, F.lit(WS)) / some).otherwise(0.0),
        "word_count": count,
        "avg_word_length": F.when(count > 0, F.length(F.array_join(words, "")) / F.greatest(count, F.lit(1))).otherwise(0.0),
        "common_words": F.size(F.filter(words, lambda w: w.isin(COMMON_WORDS))),
        "sentence_markers": F.regexp_count(t, F.lit("[.!?]")),
        "unicode_errors": F.regexp_count(t, F.lit(r"\x{FFFD}")) + F.regexp_count(t, F.lit(r"\x00")) + hidden,
        "text_density": F.when(area > 0, n / area).otherwise(0.0),
    }


def text_metrics(text: Column, area: Column | float = 612.0 * 792.0, strip: bool = True) -> dict[str, Column]:
    """Character and word statistics of a page, as columns. ``strip``: measure the stripped text. Columns that use each
    other measure again; over tables, ``with_metrics`` measures once."""
    t = py_strip(text_of(text)) if strip else text_of(text)
    return _metrics_of(t, ascii_words(t), area if isinstance(area, Column) else F.lit(float(area)))


def with_metrics(rows: DataFrame, text: str | Column = "text", area: Column | float = 612.0 * 792.0, strip: bool = True) -> DataFrame:
    """``rows`` with the columns ``METRICS``; each text is stripped and cut into words once."""
    t = text_of(F.col(text) if isinstance(text, str) else text)
    area = area if isinstance(area, Column) else F.lit(float(area))
    once = rows.withColumn("__text", py_strip(t) if strip else t).withColumn("__area", area)
    once = once.withColumn("__words", ascii_words(F.col("__text")))
    return once.withColumns(_metrics_of(F.col("__text"), F.col("__words"), F.col("__area"))).drop("__text", "__area", "__words")


def measured() -> dict[str, Column]:
    """The columns that ``with_metrics`` adds."""
    return {k: F.col(k) for k in METRICS}


def confidence(m: dict[str, Column]) -> Column:
    """Eight weighted terms, added in a fixed order."""
    one, zero = F.lit(1.0), F.lit(0.0)
    ws, wl, density, n = m["whitespace_ratio"], m["avg_word_length"], m["text_density"], m["total_chars"]
    ws_term = F.when(ws.between(0.10, 0.25), one).when(ws < 0.10, ws / F.lit(0.10)).otherwise(F.greatest(zero, 1 - (ws - F.lit(0.25)) / F.lit(0.15)))
    wl_term = F.when(wl.between(4, 7), one).when((wl >= 2) & (wl < 4), (wl - 2) / F.lit(2.0)).when((wl > 7) & (wl <= 15), F.greatest(zero, 1 - (wl - 7) / F.lit(8.0))).otherwise(zero)
    common = F.when(m["word_count"] > 0, F.least(m["common_words"] / F.greatest(m["word_count"], F.lit(1)) / F.lit(0.10), one)).otherwise(zero)
    density_term = F.when(density.between(0.001, 0.1), one).when(density < 0.001, density / F.lit(0.001)).otherwise(F.greatest(zero, 1 - (density - F.lit(0.1)) / F.lit(0.1)))
    terms = [
        F.lit(0.15) * F.least(m["printable_ratio"] / F.lit(0.95), one),
        F.lit(0.15) * F.least(m["alphanumeric_ratio"] / F.lit(0.70), one),
        F.lit(0.10) * ws_term,
        F.lit(0.15) * wl_term,
        F.lit(0.10) * F.least(m["word_count"] / F.lit(50.0), one),
        F.lit(0.15) * common,
        F.lit(0.10) * F.greatest(zero, 1 - 10 * m["unicode_errors"] / F.greatest(n, F.lit(1))),
        F.lit(0.10) * density_term,
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(n > 0, F.round(total, 6)).otherwise(0.0)


def _area(boxes: Column, width: Column, height: Column) -> Column:
    """Sum of the boxes' areas within the page; overlaps count twice."""

    def clipped(b: Column) -> Column:
        w = F.least(b["x1"], width) - F.greatest(b["x0"], F.lit(0.0))
        h = F.least(b["y1"], height) - F.greatest(b["y0"], F.lit(0.0))
        return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)

    return F.aggregate(F.transform(F.coalesce(boxes, F.expr("array()")), clipped), F.lit(0.0), lambda a, x: a + x)


def coverage(blocks: Column, images: Column, width: Column, height: Column) -> dict[str, Column]:
    """Shares of the page under text, under images, and under neither; unknown sizes cover nothing."""
    area = width * height
    text, image = _area(blocks, width, height), _area(images, width, height)
    known = area > 0
    share = lambda x: F.when(known, F.least(F.lit(1.0), x / area)).otherwise(0.0)
    return {
        "text_coverage": F.round(share(text), 6),
        "image_coverage": F.round(share(image), 6),
        "uncovered": F.round(F.when(known, F.greatest(F.lit(0.0), 1 - share(text + image))).otherwise(1.0), 6),
    }


def coverage_confidence(text_coverage: Column, uncovered: Column, has_images: Column, n_blocks: Column) -> Column:
    base = F.when(text_coverage >= 0.8, 1.0).when(text_coverage >= 0.6, 0.9).when(text_coverage >= 0.4, 0.7).when(text_coverage >= 0.2, 0.4).otherwise(0.2)
    base = base * F.when(has_images & (uncovered > 0.3), 0.5).otherwise(1.0)
    base = base * F.when((n_blocks < 3) & (text_coverage < 0.5), 0.6).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 6)


def adjusted_confidence(conf: Column, cov_conf: Column) -> Column:
    return F.round(F.when((cov_conf < 0.5) & (conf < 0.80), conf * cov_conf).otherwise(conf), 6)


def page_valid(m: dict[str, Column], conf: Column, cov: dict[str, Column] | None = None, t: Thresholds = Thresholds(), strict: bool = False) -> Column:
    """All thresholds hold; where the confidence is below the strict one, coverage must suffice too."""
    ok = (
        (m["total_chars"] >= t.min_chars)
        & (m["printable_ratio"] >= t.min_printable)
        & (m["alphanumeric_ratio"] >= t.min_alphanumeric)
        & (m["whitespace_ratio"] <= t.max_whitespace)
        & (m["word_count"] >= t.min_words)
        & m["avg_word_length"].between(t.min_word_length, t.max_word_length)
        & (conf >= (t.strict_confidence if strict else t.min_confidence))
        & (m["text_density"] >= t.min_density)
    )
    if cov and t.check_coverage:
        covered = (cov["coverage_confidence"] >= t.min_coverage_confidence) & (cov["text_coverage"] >= t.min_text_coverage) & (cov["uncovered"] <= t.max_uncovered)
        ok = ok & ((conf >= t.strict_confidence) | covered)
    return ok


def invalid_reason(m: dict[str, Column], t: Thresholds = Thresholds()) -> Column:
    causes = F.array_compact(
        F.array(
            F.when(m["total_chars"] < t.min_chars, "too few characters"),
            F.when(m["printable_ratio"] < t.min_printable, "low printable ratio"),
            F.when(m["alphanumeric_ratio"] < t.min_alphanumeric, "low alphanumeric ratio"),
            F.when(m["unicode_errors"] > 0, "unicode errors"),
            F.when(m["common_words"] < 5, "few common words"),
            F.when(m["text_density"] < t.min_density, "low text density"),
        )
    )
    return F.concat(F.lit("OCR needed: "), F.when(F.size(causes) > 0, F.array_join(causes, ", ")).otherwise("low confidence"))


def needs_ocr_reason(m: dict[str, Column], valid: Column, force: bool = False, override: bool | None = None) -> Column:
    """Why a page goes to OCR; null if its text layer is used."""
    if override is not None:
        return F.lit("override" if override else None).cast("string")
    if force:
        return F.lit("forced")
    return F.when(~valid, invalid_reason(m))


def replace_with_ocr(original: Column, original_conf: Column, ocr_conf: Column) -> Column:
    """A good layer gives way only to clearly better text; unknown confidences count as 0.5, an empty layer always gives way."""
    o, n = F.coalesce(original_conf, F.lit(0.5)), F.coalesce(ocr_conf, F.lit(0.5))
    return F.when(F.length(py_strip(text_of(original))) == 0, True).when(o >= 0.70, F.round(n - o, 6) > 0.05).otherwise(n > o)


def retry_ladder(*attempts: tuple[str, Column]) -> Column:
    """``struct<text, engine>`` of the first valid attempt; empty and ``ALL_FAILED`` if none is."""
    from leafcut.functions.text import page_invalid_reason

    def pick(value) -> Column:
        return F.coalesce(*(F.when(page_invalid_reason(c).isNull(), value(name, c)) for name, c in attempts))

    return F.struct(F.coalesce(pick(lambda _, c: c), F.lit("")).alias("text"), F.coalesce(pick(lambda name, _: F.lit(name)), F.lit("ALL_FAILED")).alias("engine"))


def quality_report(m: dict[str, Column], conf: Column, t: Thresholds = Thresholds()) -> Column:
    """The shares with two places, rounded as they are stored: of 0.865, a little less, it is 0.86, and halves go to the
    even digit. ``format_string`` would round the shortest decimal, and halves up."""
    status = F.when(conf >= t.min_confidence, "VALID").otherwise("INVALID")
    shares = (F.format_number(x, 2) for x in (m["printable_ratio"], m["alphanumeric_ratio"], conf))
    return F.concat(F.format_string("chars %d, words %d, printable %s, alphanumeric %s, confidence %s: ", m["total_chars"], m["word_count"], *shares), status)
