"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafcut.llm.content_sort import content_sort_keep
from leafcut.llm.jaccard_join import jaccard_keep
from leafcut.llm.ordinal_toxicity import drop_toxic, fit_toxicity
from leafcut.llm.queries import tokenizer_path
from leafcut.llm.shared import Scratch, read
from leafcut.llm.spaced_seeds import drop_contaminated
from leafcut.llm.vector_packing import pack_documents


def _small_batches(spark: SparkSession) -> None:
    """Stages pass whole rows through Python; long texts should go there few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model takes for toxic go; it is learned from the labelled ones among all documents."""
    _small_batches(spark)
    model = fit_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    _small_batches(spark)
    return content_sort_keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard 0.8 or more over five words) the document with the smallest identifier stays.
    SimHash links (2 bits) are checked first; the join finds what they leave out."""
    _small_batches(spark)
    return jaccard_keep(docs, shingle=5, similarity=0.8, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    _small_batches(spark)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset."""
    _small_batches(spark)
    return pack_documents(docs, tokenizer_path(), tokens=4096)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

# The toxicity model and fingerprints cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
