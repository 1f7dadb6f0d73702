"""The catalog of documents, pages, candidates, names, results and phases, as DataFrames.

Tables are immutable: each operation returns the table's new rows, to be written by the caller; ``Catalog`` keeps them as
Parquet under one folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables, their columns, status words and phases.
SCHEMAS = {
    "_metadata": "key string, value string",
    "documents": "doc_id string, original_filename string, file_path string, total_pages int, file_size_bytes bigint, uploaded_at timestamp, processing_status string, last_updated timestamp",
    "pages": "doc_id string, page_num int, text string, text_length int, has_text_layer boolean, ocr_method string, ocr_confidence double, text_embedding array<float>, features string, processed_at timestamp",
    "split_candidates": "split_id bigint, doc_id string, split_page int, confidence double, detection_method string, reasoning string, status string, user_modified_page int, created_at timestamp, updated_at timestamp",
    "document_names": "name_id bigint, doc_id string, start_page int, end_page int, suggested_name string, reasoning string, confidence double, status string, user_final_name string, created_at timestamp",
    "split_results": "result_id bigint, doc_id string, output_filename string, output_path string, start_page int, end_page int, page_count int, file_size_bytes bigint, created_at timestamp",
    "processing_log": "log_id bigint, doc_id string, phase string, status string, message string, error_details string, timestamp timestamp",
}
DOCUMENT_STATUS = "ocr_pending ocr_complete embeddings_complete splits_detected complete".split()
PHASES = "ocr embeddings split_detection extraction complete".split()
VERSION = "1"


class Catalog:
    """The tables as Parquet under one folder; a missing folder gets empty ones and the version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_metadata")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            for name, schema in SCHEMAS.items():
                rows = [("version", VERSION)] if name == "_metadata" else []
                spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        have = set(rows.columns)
        full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMAS[name])))
        full.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rows may come from the table itself: they are written beside it first."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.next")
        self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.next").write.mode("overwrite").parquet(f"{self.path}/{name}")


def new_document(path: Column, total_pages: Column, size: Column, now: Column) -> list[Column]:
    return [F.uuid().alias("doc_id"), F.element_at(F.split(path, "/"), -1).alias("original_filename"), path.alias("file_path"), total_pages.cast("int").alias("total_pages"), size.cast("bigint").alias("file_size_bytes"), now.alias("uploaded_at"), F.lit(DOCUMENT_STATUS[0]).alias("processing_status"), now.alias("last_updated")]


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert_pages(old: DataFrame, new: DataFrame, order: str = "processed_at") -> DataFrame:
    """The table after ``new`` was written over it, with the columns of ``old``: of a key (doc_id, page_num) that ``new`` has
    several times the last by ``order`` counts. A written row stands for the old one in all columns (null where ``new`` has
    no such column), except that the embedding stays if the text is unchanged."""
    keys = ["doc_id", "page_num"]
    rest = [c for c in old.columns if c not in keys]
    have = {c: F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType) for c in rest}
    rank = [F.col(order)] if order in new.columns else []
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*(v.alias(c) for c, v in have.items())), F.struct(*rank, F.length("text"), "text")).alias("new"))
    both = old.select(*keys, F.struct(*rest).alias("old")).join(last, keys, "full")
    got = F.col("new").isNotNull()

    def value(c: str) -> Column:
        if c == "text_embedding":
            return F.when(~got | F.col("new.text").eqNullSafe(F.col("old.text")), F.col("old.text_embedding"))
        return F.when(got, F.length("new.text") if c == "text_length" else F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return both.select(*keys, *(value(c).alias(c) for c in rest)).select(*old.columns)


def update_embeddings(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """New vectors for the pages that exist; others are left out."""
    v = vectors.select("doc_id", "page_num", F.col("text_embedding").alias("_new"))
    return pages.join(v, ["doc_id", "page_num"], "left").withColumn("text_embedding", F.coalesce("_new", "text_embedding")).drop("_new")


def of_document(rows: DataFrame, doc_id: object, order: str | None = None) -> DataFrame:
    """The rows of a document, sorted if ``order`` names a column: a document, its pages, names or candidates."""
    found = rows.where(F.col("doc_id") == F.lit(doc_id))
    return found.orderBy(order) if order else found


def page_of(pages: DataFrame, doc_id: object, page: int) -> DataFrame:
    """Text and embedding of a page; no row if there is none."""
    return pages.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("page_num") == F.lit(page))).select("text", "text_embedding")


def in_document_order(rows: DataFrame, *order: str) -> DataFrame:
    """Of every document at once: rows with ``nth``, their 0-based place by ``order`` within their document."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def set_document_status(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes``: ``doc_id, status``. Documents that exist get the status and ``last_updated``."""
    c = changes.select("doc_id", F.col("status").alias("_s"))
    out = documents.join(c, "doc_id", "left")
    return out.withColumn("processing_status", F.coalesce("_s", "processing_status")).withColumn("last_updated", F.when(F.col("_s").isNotNull(), now).otherwise(F.col("last_updated"))).drop("_s").select(*documents.columns)


def completeness(pages: DataFrame, documents: DataFrame, share: float = 0.8) -> DataFrame:
    """``n_embedded``, ``has_all`` and ``enough`` of each document; one without pages has neither."""
    n = pages.groupBy("doc_id").agg(F.count("text_embedding").alias("n_embedded"))
    out = documents.select("doc_id", "total_pages").join(n, "doc_id", "left").withColumn("n_embedded", F.coalesce("n_embedded", F.lit(0)))
    return out.withColumn("has_all", F.col("n_embedded") == F.col("total_pages")).withColumn("enough", (F.col("total_pages") > 0) & (F.col("n_embedded") >= F.col("total_pages") * F.lit(share)))


def expire(documents: DataFrame, now: Column | datetime, days: int = 30) -> DataFrame:
    now = now if isinstance(now, Column) else F.lit(now)
    return documents.where(F.col("uploaded_at") >= now - F.make_interval(days=F.lit(days)))


def clear(documents: DataFrame) -> tuple[DataFrame, int]:
    """No documents, and how many there were."""
    return documents.limit(0), documents.count()


def cascade(child: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of a child table whose document is kept."""
    return child.join(kept.select("doc_id"), "doc_id", "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def candidate_rows(candidates: DataFrame, now: Column) -> DataFrame:
    """Candidates as stored: reasons as JSON, pending, ids by content, so that a second run writes the same rows."""
    reasoning = F.to_json(F.struct("signals", F.col("signal_count").cast("int").alias("signal_count")))
    return candidates.select(F.xxhash64("bundle_id", "page_num").alias("split_id"), F.col("bundle_id").alias("doc_id"), F.col("page_num").alias("split_page"), "confidence", F.col("method").alias("detection_method"), reasoning.alias("reasoning"), F.lit("pending").alias("status"), F.lit(None).cast("int").alias("user_modified_page"), now.alias("created_at"), now.alias("updated_at"))


def candidate_scan(rows: DataFrame, status: str | None = None) -> DataFrame:
    out = rows.where(F.col("status") == status) if status else rows
    return out.withColumn("reasoning", F.from_json("reasoning", "signals array<string>, signal_count int"))


def set_status(rows: DataFrame, key: str, value: object, status: str, now: Column, page: int | None = None) -> DataFrame:
    hit = F.col(key) == F.lit(value)
    out = rows.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return out if page is None else out.withColumn("user_modified_page", F.when(hit, page).otherwise(F.col("user_modified_page")))


def confirm_name(rows: DataFrame, name_id: int, final: str, status: str = "confirmed") -> DataFrame:
    hit = F.col("name_id") == name_id
    return rows.withColumn("user_final_name", F.when(hit, final).otherwise(F.col("user_final_name"))).withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def last_phase(log: DataFrame) -> DataFrame:
    """The phase completed last; ties by the greater log_id."""
    return log.where("status = 'completed'").groupBy("doc_id").agg(F.max_by("phase", F.struct("timestamp", "log_id")).alias("last_phase"))


def phase_done(last: Column, phase: str) -> Column:
    """Whether ``phase`` need not run again."""
    rank = F.array_position(F.array(*map(F.lit, PHASES)), last)
    return F.coalesce(rank >= PHASES.index(phase) + 1, F.lit(False))


def cache_stats(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: documents, oldest upload, bytes of vectors and of text, and their MB."""
    d = documents.agg(F.count("*").alias("n_documents"), F.min("uploaded_at").alias("oldest"))
    zero = F.lit(0)
    p = pages.agg(F.coalesce(F.sum(F.size("text_embedding") * 4).cast("bigint"), zero).alias("embedding_bytes"), F.coalesce(F.sum(F.length("text")), zero).alias("text_bytes"), F.count("text_embedding").alias("n_embeddings"))
    one = d.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")  # a row each
    return one.withColumn("embedding_mb", F.round(F.col("embedding_bytes") / 1048576, 2)).withColumn("text_mb", F.round(F.col("text_bytes") / 1048576, 2))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("pending", "processing", "complete", "failed")), F.count("*").alias("total"))


STATUS_RANK = {"pending": 0, "processing": 1, "complete": 2, "failed": 3}


def queue_order(rows: DataFrame, by: str, ascending: bool = True, tie: str = "id") -> DataFrame:
    """The queue sorted by a column, statuses by their rank."""
    key = F.coalesce(*(F.when(F.col("status") == s, r) for s, r in STATUS_RANK.items())) if by == "status" else F.col(by)
    return rows.orderBy(key.asc() if ascending else key.desc(), tie)


def update_queue(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Status from ``changes`` by id; progress stays where none is given, error is overwritten."""
    c = changes.select("id", F.col("status").alias("_s"), F.col("progress").alias("_p"), F.col("error").alias("_e"))
    out = rows.join(c, "id", "left")
    hit = F.col("_s").isNotNull()
    return out.withColumn("status", F.coalesce("_s", "status")).withColumn("progress", F.coalesce("_p", "progress")).withColumn("error", F.when(hit, F.col("_e")).otherwise(F.col("error"))).drop("_s", "_p", "_e")


def append_queue(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` as pending items without progress behind the queue's own; ids that are missing are made."""
    made = files if "id" in files.columns else files.withColumn("id", F.uuid())
    return rows.unionByName(made.withColumn("status", F.lit("pending")).withColumn("progress", F.lit(0)), allowMissingColumns=True)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\\\]"), -1)


def results_by_name(rows: DataFrame, results: DataFrame, path: str = "file_path") -> DataFrame:
    """Queue items with the status of the result that has their file's name (``file, status``; of several, failed wins)."""
    r = results.groupBy(base_name(F.col("file")).alias("_name")).agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.max("status")).alias("_s"))
    out = rows.withColumn("_name", base_name(F.col(path))).join(r, "_name", "left")
    return out.withColumn("status", F.coalesce("_s", "status")).drop("_s", "_name").select(*rows.columns)


def queue_state(rows: DataFrame) -> DataFrame:
    """One row: whether any file is being processed, and whether the queue is empty."""
    return rows.agg(F.coalesce(F.bool_or(F.col("status") == "processing"), F.lit(False)).alias("any_processing"), (F.count("*") == 0).alias("empty"))


def batch_stats(rows: DataFrame) -> DataFrame:
    """Totals by status, and pages a second (0 without duration)."""
    out = rows.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "complete").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return out.withColumn("pages_per_second", F.when(F.col("seconds") > 0, F.round(F.col("pages") / F.col("seconds"), 2)).otherwise(0.0))


def batches(rows: DataFrame, size: int, by: str = "bundle_id", order: str = "page_num") -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


# Percent of the whole at which phases begin and end.
PHASE_BANDS = {"ocr": (5, 30), "embeddings": (30, 50), "split_detection": (50, 65), "extraction": (80, 95), "complete": (100, 100)}


def phase_percent(phase: Column, current: Column, total: Column) -> Column:
    """Percent of the whole, from how far a phase has come; null for unknown phases."""
    share = F.when(total > 0, current / total).otherwise(0.0)
    return F.coalesce(*(F.when(phase == name, F.lit(a) + F.floor(share * (b - a))) for name, (a, b) in PHASE_BANDS.items())).cast("int")


def progress(current: Column, total: Column, elapsed: Column) -> list[Column]:
    """Percent done, and seconds left (0 where unknown)."""
    percent = F.when(total > 0, F.round(current / total * 100, 6)).otherwise(0.0)
    left = F.when((current > 0) & (elapsed > 0), F.round((total - current) / (current / elapsed), 6)).otherwise(0.0)
    return [percent.alias("percent"), left.alias("eta")]
