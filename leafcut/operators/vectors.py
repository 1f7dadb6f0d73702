"""Vector operators: dot product, normalisation, similarity matrix, density clusters within a bundle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096  # pages
ROWS = 512
MATRIX_BLOCK = 1024  # pages; each two blocks give 2 million pairs
PAIRS = 1 << 17
SPEAKING, SPEAKERS = 4, 16  # parts of a block, pages of a part


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, rounded so that thresholds fall alike everywhere; null if either is null."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), 6)


def normalise(a: Column) -> Column:
    wide = F.transform(a, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-8)
    return F.transform(wide, lambda x: x / norm)


def with_embeddings(pages: DataFrame, embeddings: DataFrame, dimension: int = 64) -> DataFrame:
    """Left join on ``doc_id``; a page without vector gets zeros."""
    vectors = embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return pages.join(vectors, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dimension)))


def similarity_matrix(pages: DataFrame) -> DataFrame:
    """``bundle_id, i, j, similarity`` of all pairs of pages of a bundle: the matrix is the result.

    A task for each two blocks of a bundle multiplies them a few rows at a time, so it holds two blocks and ``PAIRS`` results.
    Similarities are null where lengths differ or a number is null.
    """
    rows = pages.where("bundle_id is not null").select("bundle_id", "page_num", "embedding")
    out = T.StructType([rows.schema["bundle_id"], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    tasks = 8 * pages.sparkSession.sparkContext.defaultParallelism  # few MB are shuffled, so Spark would join them into few tasks
    return _blocks(rows, MATRIX_BLOCK).repartition(tasks, "bundle_id", "a", "b").groupBy("bundle_id", "a", "b").applyInArrow(_products, out)


def _units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, filled up with zeros to the longest, and their lengths; -1: null, or with a null."""
    column = rows.column("embedding").combine_chunks()
    size = np.asarray(pc.list_value_length(column).fill_null(-1), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    at = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    x = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    x[at, np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(np.maximum(size, 0))[:-1]], np.maximum(size, 0))] = flat
    size[at[np.asarray(column.flatten().is_null())]] = -1
    x[size < 0] = 0
    return x / (np.sqrt((x * x).sum(1)) + 1e-8)[:, None], size


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches))
    block = rows.column("page_num").to_numpy() // MATRIX_BLOCK
    a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    bundle, page = rows.column("bundle_id")[0], rows.column("page_num").to_numpy()
    v, size = _units(rows)
    one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
    for first, second in ((one, two),) if a == b else ((one, two), (two, one)):
        few = max(1, PAIRS // max(1, len(second)))
        y, page_y, size_y = v[second].T, page[second].astype(np.int32), size[second]
        for k in range(0, len(first), few):
            some = first[k : k + few]
            x = v[some] @ y
            near = (np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0).ravel()
            unknown = ((size[some][:, None] != size_y) | (size[some] < 0)[:, None]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(bundle, len(near)), pa.array(np.repeat(page[some].astype(np.int32), len(second))), pa.array(np.tile(page_y, len(some))), pa.array(near, mask=unknown if unknown.any() else None)],
                ["bundle_id", "i", "j", "similarity"],
            )


def _matrix(rows: pa.Table) -> np.ndarray:
    column = rows.column("embedding").combine_chunks()
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows of ``y`` are neighbours of rows of ``x``, a few rows at a time."""
    for a in range(0, len(x), ROWS):
        yield a, np.round(x[a : a + ROWS] @ y.T, 6) >= 1 - eps


def _joined(near: Iterator[tuple[int, np.ndarray]], core_x: np.ndarray, core_y: np.ndarray, first_y: int) -> np.ndarray:
    """Of the rows of both sides (those of ``y`` from ``first_y`` on): the least row that each hangs together with."""
    up = np.arange(first_y + len(core_y))
    for a, some in near:
        for i, row in enumerate(some, a):
            if core_x[i]:
                tops = up[first_y + np.flatnonzero(row & core_y)]
                if (tops != up[i]).any():
                    tops = np.unique(np.r_[tops, up[i]])
                    up[np.isin(up, tops[1:])] = tops[0]
    return up


def _blocks(pages: DataFrame, size: int | None = None) -> DataFrame:
    """Every page once for each block of its bundle that it is compared with: ``bundle_id, a, b`` and the page's columns."""
    own = pages.withColumn("_block", F.floor(F.col("page_num") / (size or BLOCK)).cast("int"))
    last = own.groupBy("bundle_id").agg(F.max("_block").alias("_last"))
    sent = own.join(last, "bundle_id").withColumn("_other", F.explode(F.sequence(F.lit(0), "_last")))
    return sent.select(*pages.columns, F.least("_block", "_other").alias("a"), F.greatest("_block", "_other").alias("b"))


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """Pages of the one and of the other block in order, and whether they are the same."""
    rows = rows.sort_by("page_num")
    a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    block = rows.column("page_num").to_numpy() // BLOCK
    return rows.filter(pa.array(block == a)), rows.filter(pa.array(block == b)), a == b


def _counts(eps: float):
    def run(rows: pa.Table) -> pa.Table:
        one, two, same = _sides(rows)
        x, y = _matrix(one), _matrix(two)
        of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for a, near in _near(x, y, eps):
            of_x[a : a + len(near)] += near.sum(1)
            of_y += near.sum(0)
        page, n = (one.column("page_num").to_numpy(), of_x) if same else (np.r_[one.column("page_num").to_numpy(), two.column("page_num").to_numpy()], np.r_[of_x, of_y])
        return pa.table({"bundle_id": pa.array([rows.column("bundle_id")[0].as_py()] * len(page), pa.string()), "page_num": pa.array(page, pa.int32()), "n": pa.array(n)})

    return run


def _tops(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that are linked, and of each the place of the least that it hangs together with."""
    pages, at = np.unique(np.r_[u, v], return_inverse=True)
    u, v, top = at[: len(u)], at[len(u) :], np.arange(len(pages))
    while (apart := top[u] != top[v]).any():
        p, q = top[u[apart]], top[v[apart]]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (top[top] != top).any():
            top = top[top]
    return pages, top


def _hanging(rows: pa.Table, eps: float) -> np.ndarray:
    x, all_ = _matrix(rows), np.ones(len(rows), bool)
    up = _joined(_near(x, x, eps), all_, all_, 0)
    return _tops(np.arange(len(up)), up)[1]


def _parts(eps: float):
    """Pages of a block with the first page of what they hang together with there; a few of the largest parts speak for it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("page_num")
        top = _hanging(rows, eps)
        part, at, n = np.unique(top, return_inverse=True, return_counts=True)
        large = np.zeros(len(part), bool)
        large[np.argsort(-n, kind="stable")[:SPEAKING]] = True
        order = np.argsort(at, kind="stable")
        nth = np.empty(len(top), int)
        nth[order] = np.arange(len(top)) - np.repeat(np.cumsum(n) - n, n)
        page = rows.column("page_num").to_numpy()
        return rows.append_column("top", pa.array(page[top], pa.int32())).append_column("speaks", pa.array(large[at] & (nth < SPEAKERS)))

    return run


def _joint(eps: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("page_num")
        own = rows.column("top").to_numpy()
        top, at = _tops(own, own[_hanging(rows, eps)])
        return pa.table({"bundle_id": pa.array([rows.column("bundle_id")[0].as_py()] * len(top), pa.string()), "top": pa.array(top, pa.int32()), "joint": pa.array(top[at], pa.int32())})

    return run


def _meetings(eps: float):
    """Labels of outside pages with those of the block's pages that they are near to."""

    def run(rows: pa.Table) -> pa.Table:
        outer = rows.column("outer").to_numpy()
        one, two = rows.filter(pa.array(outer)), rows.filter(pa.array(~outer))
        a, b = one.column("label").to_numpy().astype(np.int64), two.column("label").to_numpy().astype(np.int64)
        met = np.empty(0, np.int64)
        for k, near in _near(_matrix(one), _matrix(two), eps) if len(two) else ():
            i, j = np.nonzero(near)
            u, v = a[k + i], b[j]
            met = np.union1d(met, (u << 32 | v)[u != v])
        return pa.table({"bundle_id": pa.array([rows.column("bundle_id")[0].as_py()] * len(met), pa.string()), "u": pa.array(met >> 32, pa.int32()), "v": pa.array(met & 0xFFFFFFFF, pa.int32())})

    return run


def _linked(core: DataFrame, eps: float) -> DataFrame:
    """Links ``bundle_id, u, v`` that hold together the pages that hang together by any of all pairs of a bundle.

    Pairs within one part need no comparison. So blocks are joined by themselves, then by a few pages of their largest parts;
    only pages outside the largest part of their bundle then meet all others of it, block by block.
    """
    alone = core.where(~F.exists("embedding", lambda x: x != 0)) if eps < 1 else core.limit(0)
    if eps < 1:  # zeros are near to nothing
        core = core.where(F.exists("embedding", lambda x: x != 0))
    own = core.select("bundle_id", "page_num", "embedding", F.floor(F.col("page_num") / BLOCK).cast("int").alias("_block"))
    kind = core.schema["embedding"].dataType.simpleString()
    parts = own.groupBy("bundle_id", "_block").applyInArrow(_parts(eps), f"bundle_id string, page_num int, embedding {kind}, _block int, top int, speaks boolean")
    joint = parts.where("speaks").groupBy("bundle_id").applyInArrow(_joint(eps), "bundle_id string, top int, joint int")
    known = parts.join(joint, ["bundle_id", "top"], "left").select("bundle_id", "page_num", "embedding", "_block", F.coalesce("joint", "top").alias("label"))
    sizes = known.groupBy("bundle_id", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("bundle_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("_most"))
    w = Window.partitionBy("bundle_id").orderBy("page_num")
    outside = known.join(most, "bundle_id").where("label != _most").withColumn("_chunk", F.floor((F.row_number().over(w) - 1) / BLOCK).cast("int"))
    chunks = outside.groupBy("bundle_id").agg(F.max("_chunk").alias("_last"))
    blocks = known.select("bundle_id", "_block").distinct()
    pages = known.join(chunks, "bundle_id").select("bundle_id", "embedding", "label", "_block", F.explode(F.sequence(F.lit(0), "_last")).alias("_chunk"), F.lit(False).alias("outer"))
    sent = pages.unionByName(outside.drop("_block").join(blocks, "bundle_id").select("bundle_id", "embedding", "label", "_block", "_chunk", F.lit(True).alias("outer")))
    met = sent.groupBy("bundle_id", "_block", "_chunk").applyInArrow(_meetings(eps), "bundle_id string, u int, v int")
    itself = alone.select("bundle_id", F.col("page_num").alias("u"), F.col("page_num").alias("v"))
    return known.select("bundle_id", F.col("page_num").alias("u"), F.col("label").alias("v")).unionByName(met).unionByName(itself)


def _numbered(rows: pa.Table) -> pa.Table:
    """Labels of a bundle's core pages from links of pages, numbered by the first page of each cluster."""
    pages, top = _tops(rows.column("u").to_numpy(), rows.column("v").to_numpy())
    _, label = np.unique(top, return_inverse=True)
    return pa.table({"bundle_id": pa.array([rows.column("bundle_id")[0].as_py()] * len(pages), pa.string()), "page_num": pa.array(pages, pa.int32()), "label": pa.array(label, pa.int32())})


def _borders(eps: float):
    def run(rows: pa.Table) -> pa.Table:
        one, two, same = _sides(rows)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in ((one, two),) if same else ((one, two), (two, one)):
            label = y.column("label").fill_null(-1).to_numpy()
            outside, core = np.flatnonzero(x.column("label").is_null().to_numpy(zero_copy_only=False)) if len(x) else np.empty(0, int), label >= 0
            for a, near in _near(_matrix(x)[outside], _matrix(y), eps):
                best = np.where(near & core, label, np.iinfo(np.int32).max).min(1, initial=np.iinfo(np.int32).max)
                hit = best < np.iinfo(np.int32).max
                found.append((x.column("page_num").to_numpy()[outside[a : a + len(near)][hit]], best[hit]))
        page, label = (np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))
        return pa.table({"bundle_id": pa.array([rows.column("bundle_id")[0].as_py()] * len(page), pa.string()), "page_num": pa.array(page, pa.int32()), "label": pa.array(label, pa.int32())})

    return run


def cluster_labels(pages: DataFrame, eps: float = 0.5, min_samples: int = 1) -> DataFrame:
    """``bundle_id, page_num, label``: density clusters by cosine distance, numbered by their first core page; -1: noise.

    Pages are 0-based and compared block by block, of different parts only (``_linked``); with ``min_samples`` of 2 or more
    all pairs are counted, a task for each two blocks of a bundle. What hangs together is joined in a task for each bundle,
    from a row for each page and few more without vectors. A page that is near to clusters without being core takes the first of them. Pages need a number each and vectors of one length.
    """
    rows = pages.select("bundle_id", "page_num", "embedding")
    if min_samples > 1:
        zero = ~F.exists("embedding", lambda x: x != 0)
        counts = _blocks(rows).groupBy("bundle_id", "a", "b").applyInArrow(_counts(eps), "bundle_id string, page_num int, n long")
        counts = counts.groupBy("bundle_id", "page_num").agg(F.sum("n").alias("n"))
        core = rows.join(counts, ["bundle_id", "page_num"]).select("bundle_id", "page_num", "embedding", ((F.col("n") >= min_samples) & ~zero).alias("core"))
    else:
        core = rows.withColumn("core", F.lit(True))
    linked = _linked(core.where("core and bundle_id is not null"), eps)
    labels = linked.groupBy("bundle_id").applyInArrow(_numbered, "bundle_id string, page_num int, label int")
    if min_samples <= 1:
        return labels
    placed = rows.join(labels, ["bundle_id", "page_num"], "left")
    borders = _blocks(placed).groupBy("bundle_id", "a", "b").applyInArrow(_borders(eps), "bundle_id string, page_num int, label int")
    borders = borders.groupBy("bundle_id", "page_num").agg(F.min("label").alias("border"))
    return placed.join(borders, ["bundle_id", "page_num"], "left").select("bundle_id", "page_num", F.coalesce("label", "border", F.lit(-1)).alias("label"))
