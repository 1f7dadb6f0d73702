"""From accepted candidates to named segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafcut.functions.text import fallback_name, heuristic_name, name_of_answer, naming_prompt
from leafcut.operators.models import apply_model


def accept(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    return candidates.where(F.col("confidence") >= threshold)


def segments(totals: DataFrame, accepted: DataFrame) -> DataFrame:
    """``bundle_id, segment_idx, start_page, end_page, page_count, confidence``.

    ``totals``: ``bundle_id, total``. Segments start at page 0 and at every accepted page; both ends are inclusive.
    """
    known = accepted.join(totals, "bundle_id").where("page_num > 0 and page_num < total").select("bundle_id", "page_num", "confidence")
    starts = known.union(totals.where("total > 0").select("bundle_id", F.lit(0).alias("page_num"), F.lit(None).cast("double").alias("confidence")))
    starts = starts.groupBy("bundle_id", "page_num").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("bundle_id").orderBy("page_num")
    out = starts.join(totals, "bundle_id").withColumn("end_page", F.coalesce(F.lead("page_num").over(w), F.col("total")) - 1)
    return out.select("bundle_id", (F.row_number().over(w) - 1).alias("segment_idx"), F.col("page_num").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), (F.col("end_page") - F.col("page_num") + 1).cast("long").alias("page_count"), "confidence")


def with_page_texts(segs: DataFrame, pages: DataFrame) -> DataFrame:
    """``first_text`` ('' if missing) and ``second_text`` (null beyond the segment's end)."""
    first = pages.select("bundle_id", F.col("page_num").alias("start_page"), F.col("text").alias("first_text"))
    second = pages.select("bundle_id", F.col("page_num").alias("second_page"), F.col("text").alias("second_text"))
    out = segs.join(first, ["bundle_id", "start_page"], "left").withColumn("second_page", F.when(F.col("start_page") + 1 <= F.col("end_page"), F.col("start_page") + 1))
    return out.join(second, ["bundle_id", "second_page"], "left").drop("second_page").withColumn("first_text", F.coalesce("first_text", F.lit("")))


def named(segs: DataFrame, prefix: str = "document", suggested: str | None = None) -> DataFrame:
    """``suggested_name``: of the column ``suggested`` where it has one, else by the first page; ``method`` says which."""
    plain = heuristic_name(F.col("first_text"), F.col("segment_idx") + 1, prefix)
    if suggested is None:
        return segs.withColumn("suggested_name", plain).withColumn("naming", F.lit("heuristic"))
    return segs.withColumn("naming", F.when(F.col(suggested).isNotNull(), "model").otherwise("heuristic")).withColumn("suggested_name", F.coalesce(suggested, plain))


def unique_names(rows: DataFrame, by: str = "bundle_id", name: str = "suggested_name", order: str = "segment_idx", existing: DataFrame | None = None) -> DataFrame:
    """``output_filename``: name.pdf if it is free in the bundle, else the first free of name_1.pdf, name_2.pdf, ..., one after
    another by ``order``. ``existing``: ``by`` and ``output_filename`` of files that are there already.

    Names can only meet if they are alike but for numbers at their ends, so each such family is numbered by itself.
    """
    root = lambda c: F.regexp_replace(c, r"(_[0-9]+)+\z", "")
    out = T.StructType([*rows.schema.fields, T.StructField("output_filename", T.StringType())])
    cols = [f.name for f in rows.schema.fields]

    def run(rows: pa.Table) -> pa.Table:
        files, bases, at = (rows.column(c).to_pylist() for c in ("_taken", name, order))
        taken = {f for f in files if f is not None}
        own = sorted((k for k, f in enumerate(files) if f is None), key=at.__getitem__)
        following: dict[str, int] = {}
        names = []
        for base in map(bases.__getitem__, own):
            k = following.get(base, 0)
            while (free := f"{base}_{k}.pdf" if k else f"{base}.pdf") in taken:
                k += 1
            following[base] = k + 1
            taken.add(free)
            names.append(free)
        return rows.select(cols).take(pa.array(own, pa.int64())).append_column("output_filename", pa.array(names, pa.string()))

    sent = rows.withColumn("_taken", F.lit(None).cast("string")).withColumn("_root", root(F.col(name)))
    if existing is not None:
        files = existing.select(by, F.col("output_filename").alias("_taken"), root(F.regexp_replace("output_filename", r"\.pdf\z", "")).alias("_root"))
        sent = sent.unionByName(files, allowMissingColumns=True)
    return sent.groupBy(by, "_root").applyInArrow(run, out)


def suggest_names(segs: DataFrame, model: str, prefix: str = "document") -> DataFrame:
    """Names by a language model: prompt, answer, parsed and mended name; where the answer gives only the fallback name, the
    heuristic one. Adds ``suggested_name`` and ``naming``."""
    page = F.col("start_page")
    asked = segs.withColumn("_answer", apply_model(naming_prompt(F.col("first_text"), F.col("second_text")), model, "string"))
    found = F.when(F.length("_answer") > 0, name_of_answer(F.col("_answer"), page, prefix))
    asked = asked.withColumn("_name", F.when(found != fallback_name(prefix, page), found)).drop("_answer")
    return named(asked, prefix, "_name").drop("_name")


def summary(segs: DataFrame) -> DataFrame:
    return segs.groupBy("bundle_id").agg(F.count("*").alias("segments"), F.sum("page_count").alias("pages"), F.max("page_count").alias("longest"))


def page_ranges(segs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page with its segment: rows to be written partitioned by bundle and segment."""
    w = Window.partitionBy("bundle_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    starts = segs.select("bundle_id", F.col("start_page").alias("page_num"), "segment_idx")
    return pages.join(starts, ["bundle_id", "page_num"], "left").withColumn("segment_idx", F.last("segment_idx", ignorenulls=True).over(w))
