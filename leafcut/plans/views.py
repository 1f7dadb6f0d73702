"""How the driver's tables stand in for bundles of pages, logs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Pages are a source's documents by id."""
    docs = table(spark, d, "documents").select(F.col("source").alias("bundle_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("page_num", (F.row_number().over(Window.partitionBy("bundle_id").orderBy("doc_id")) - 1).cast("int"))


def measured_bundle(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("number", "header_footer", "blank"), names: bool = False) -> DataFrame:
    """As ``text_bundle``, with what the detectors compare, and ``plain_name`` if asked for, in place of texts, which are not shuffled."""
    from leafcut.functions.text import with_plain_name
    from leafcut.operators.detect import measures

    docs = table(spark, d, "documents").select(F.col("source").alias("bundle_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_plain_name(docs) if names else docs
    docs = docs.select("bundle_id", "doc_id", *measures(kinds), *(["plain_name"] if names else []))
    return docs.withColumn("page_num", (F.row_number().over(Window.partitionBy("bundle_id").orderBy("doc_id")) - 1).cast("int"))


def page_order(spark: SparkSession, d: str) -> DataFrame:
    """``bundle_id, doc_id, page_num`` without texts: the window sorts narrow rows, and texts join by ``doc_id`` where they are needed."""
    docs = table(spark, d, "documents").select(F.col("source").alias("bundle_id"), "doc_id")
    return docs.withColumn("page_num", (F.row_number().over(Window.partitionBy("bundle_id").orderBy("doc_id")) - 1).cast("int"))


def vector_bundle(spark: SparkSession, d: str) -> DataFrame:
    from leafcut.operators.vectors import with_embeddings

    return with_embeddings(page_order(spark, d), table(spark, d, "embeddings"))


def numbered_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Pages are a supplier's lines, with page numbers written in four ways."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("bundle_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int")
    text = F.when(q % 4 == 0, F.concat(F.lit("Page "), n)).when(q % 4 == 1, F.concat(F.lit("see p. "), q.cast("string"))).when(q % 4 == 2, F.concat(F.lit("top\n"), n, F.lit("\nbottom"))).otherwise(F.concat(F.lit("- "), n, F.lit(" -")))
    w = Window.partitionBy("bundle_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rows.select("bundle_id", (F.row_number().over(w) - 1).cast("int").alias("page_num"), text.alias("text"))


def chat_bundle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("bundle_id"), F.col("turn").cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a processing log: phases by event type, status by value."""
    e = table(spark, d, "events")
    status = F.when(F.col("value") < 20, "failed").when(F.col("value") < 60, "started").otherwise("completed")
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("phase"), status.alias("status"), F.col("ts").alias("timestamp"), "value", "props")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a registry of files."""
    o = table(spark, d, "orders")
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total_pages"))
    rows = o.join(pages, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("/in/"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file_path"), F.col("o_orderdate").alias("uploaded_at"), F.coalesce("total_pages", F.lit(0)).cast("int").alias("total_pages"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").cast("bigint").alias("size"))


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 612 x 792 with a text block and sometimes an image, sized by quantity and discount."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    box = lambda x0, y0, x1, y1: F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    text = F.array(box(F.lit(36), F.lit(36), F.lit(576), F.lit(36) + F.col("l_quantity") * 16), box(F.lit(-10), F.lit(760), F.lit(300), F.lit(800)))
    image = F.when(F.col("l_discount") > 0.05, F.array(box(F.lit(50), F.lit(400), F.lit(562), F.lit(400) + F.col("l_tax") * 4000))).otherwise(F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>)"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("blocks"), image.alias("images"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))
