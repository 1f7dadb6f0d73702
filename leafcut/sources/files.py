"""File sources and sinks."""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, size, modified`` of the files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def text_pages(spark: SparkSession, folder: str, page_break: str = "\f") -> DataFrame:
    """Files of text with form feeds between pages: ``bundle_id, page_num, text``."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("bundle_id"), F.split("value", page_break).alias("p"))
    return files.select("bundle_id", F.posexplode("p").alias("page_num", "text"))


Reader = Callable[[bytes], list[str]]


def form_feed_reader() -> Reader:
    """Stands in for a PDF library: pages of UTF-8 text between form feeds."""
    return lambda raw: raw.decode(errors="replace").split("\f")


def document_pages(spark: SparkSession, folder: str, reader: Callable[[], Reader] = form_feed_reader, pattern: str = "*.pdf") -> DataFrame:
    """Pages of the documents in a folder: ``bundle_id, page_num, text, problem``. ``reader`` is made once a task.

    A document that cannot be read gives one row with its ``problem`` and no page. A missing folder is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for b in batches:
            for path, raw in zip(b.column(0), b.column(1), strict=True):
                try:
                    pages, problem = read(raw.as_py()), None
                except Exception as e:  # one broken document doesn't end the others
                    pages, problem = [], f"{type(e).__name__}: {e}"
                n = max(1, len(pages))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(list(range(len(pages))) or [None], pa.int32()), pa.array(pages or [None], pa.string()), pa.array([problem] * n, pa.string())], ["bundle_id", "page_num", "text", "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "bundle_id string, page_num int, text string, problem string")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("bundle_id").agg(F.count("page_num").alias("total_pages"))


def write_segments(pages: DataFrame, folder: str) -> None:
    """A folder for each bundle and segment."""
    pages.write.mode("overwrite").partitionBy("bundle_id", "segment_idx").parquet(folder)


def zip_files(paths: list[str], target: str) -> int:
    """Deflated archive of the files that exist, under their plain names; returns how many."""
    there = [p for p in paths if Path(p).is_file()]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in there:
            z.write(p, Path(p).name)
    return len(there)


def valid_inputs(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path ends like a PDF."""
    return files.where(is_pdf(F.col(path)))


def copy_files(paths: list[str], folder: str) -> int:
    """Copies of the files that exist in an existing folder; returns how many."""
    if not Path(folder).is_dir():
        raise NotADirectoryError(folder)
    there = [p for p in paths if Path(p).is_file()]
    for p in there:
        shutil.copyfile(p, Path(folder) / Path(p).name)
    return len(there)


@F.arrow_udf(T.BinaryType())
def encode_vector(values: pa.Array) -> pa.Array:
    """float32 values as little-endian bytes: the list's own buffer under other offsets."""
    flat = values.cast(pa.list_(pa.float32()))
    offsets = np.asarray(flat.offsets).astype(np.int64)
    data = flat.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    sizes = 4 * np.where(np.asarray(flat.is_valid()), np.diff(offsets), 0)
    if not np.asarray(flat.is_valid()).all():
        data = data[np.repeat(np.asarray(flat.is_valid()), np.diff(offsets))] if len(data) == offsets[-1] - offsets[0] else data
    else:
        data = data[offsets[0] : offsets[-1]]
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.if_else(flat.is_valid(), out, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pa.Array) -> pa.Array:
    raw = pc.fill_null(blobs.cast(pa.binary()), b"")
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False) // 4
    values = np.frombuffer(b"".join(raw.to_pylist()), "<f4")
    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
    return pc.if_else(blobs.is_valid(), out, pa.scalar(None, pa.list_(pa.float32())))
