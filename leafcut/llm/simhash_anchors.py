"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is taken as two halves. Two fingerprints that differ in at most ``max_bits`` (0 to 2) differ in
at most one bit of some half. In 31 bits of a half, the codewords of the perfect [31, 26] Hamming code are the
anchors: every point lies within the covering radius 1 of exactly one anchor, its home. A fingerprint is replicated
to every anchor within covering radius plus threshold (1 + 1 bits; 1 or 16 anchors in a half), and each anchor
compares the fingerprints at home there with all that were sent to it. The bit that a half leaves out is only
ignored while candidates are sought; the comparison takes all 64.

Anchors with more than ``HOT`` fingerprints are not compared in one task. Their fingerprints are linked exactly
through midpoints: two fingerprints are within 2 bits if and only if some value lies within 1 bit of both, and at
most 65 distinct fingerprints lie within 1 bit of a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcut.llm.components import connected_components
from leafcut.llm.shared import Scratch, each_text, free_name, text_bytes, tidy

HOT = 4096
SEED = 42
N = 31
_PARITY = np.array([sum(1 << i for i in range(N) if (i + 1) >> j & 1) for j in range(5)], dtype=np.uint64)
_HOME = np.array([0] + [1 << (s - 1) for s in range(1, N + 1)], dtype=np.uint64)
_PAIRS = np.array([[(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, N + 1) if a < a ^ s] for s in range(1, N + 1)], dtype=np.uint64)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits that are set in over half of the shingles' hashes; no words: zero."""
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, width, xx = b" ".join(words), np.fromiter(map(len, words), np.int64, n) + 1, xxhash.xxh64_intdigest
        ends = np.cumsum(width)
        starts = (ends - width)[: n - shingle + 1].tolist()
        hashes = [xx(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, len(raw), 8192):
        count += np.unpackbits(raw[i : i + 8192], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint as a signed long. Lower-cases A-Z; words are runs of other than ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.lower().split(), shingle) for t in each_text(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(tidy(run), "id long, fp long")


def _anchors(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Anchors of each fingerprint in both halves: (row numbers, anchors, at home)."""
    rows = np.arange(len(fp))
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64((1 << N) - 1)
        mark = np.uint64(half << 40)
        s = np.zeros(len(x), np.int64)
        for j in range(5):
            s |= (np.bitwise_count(x & _PARITY[j]).astype(np.int64) & 1) << j
        yield rows, (x ^ _HOME[s]) | mark, True
        off = rows[s > 0]
        yield np.repeat(off, _PAIRS.shape[1]), ((x[off, None] ^ _PAIRS[s[off] - 1]) | mark).ravel(), False


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(all_fp), 4096):
            fp = all_fp[i : i + 4096]
            for rows, anchor, home in _anchors(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[rows]), pa.array(np.full(len(rows), home))], ["anchor", "fp", "home"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what earlier links have not joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    us, vs = [], []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(u), top(v)
        if p != q:
            up[max(p, q)] = min(p, q)
            us.append(u)
            vs.append(v)
    return us, vs


def _compare(max_bits: int):
    """Links within the anchors of a sorted partition; rows with ``hot`` are members of anchors left to the midpoints."""

    def link(fp: np.ndarray, home: np.ndarray, start: np.ndarray, size: np.ndarray, hot: np.ndarray) -> pa.RecordBatch | None:
        """start, size: of the anchors, whose rows stand together."""
        us, vs, flags = [], [], []
        big = np.zeros(len(start), bool)
        for g in np.flatnonzero(hot):
            m = np.unique(fp[start[g] : start[g] + size[g]])
            us.append(m), vs.append(m), flags.append(np.ones(len(m), bool))
            big[g] = True
        group = np.repeat(np.arange(len(start)), size)
        at = np.flatnonzero(home & ~big[group])
        at = at[size[group[at]] > 1]
        for k in range(0, len(at), 2048):
            h = at[k : k + 2048]
            n = size[group[h]]
            first = np.repeat(start[group[h]], n)
            other = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(fp[h], n), fp[other]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a < b)
            if near.any():
                u, v = _forest(a[near], b[near])
                us.append(np.array(u, np.uint64)), vs.append(np.array(v, np.uint64)), flags.append(np.zeros(len(u), bool))
        if not us:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64)), pa.array(np.concatenate(flags))], ["u", "v", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, fp, home = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        hot_now = None  # the anchor whose rows are passed on as they come
        for b in batches:
            anchor = np.concatenate([anchor, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            home = np.concatenate([home, b.column(2).to_numpy(zero_copy_only=False)])
            if not len(anchor):
                continue
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            size = np.diff(np.r_[start, len(anchor)])
            hot = (size > HOT) | (anchor[start] == hot_now)
            done = len(start) if hot[-1] else len(start) - 1
            hot_now = anchor[-1] if hot[-1] else None
            if done:
                cut = len(anchor) if done == len(start) else start[done]
                if (out := link(fp[:cut], home[:cut], start[:done], size[:done], hot[:done])) is not None:
                    yield out
                anchor, fp, home = anchor[cut:], fp[cut:], home[cut:]
        if len(anchor) and (out := link(fp, home, np.array([0]), np.array([len(anchor)]), np.array([len(anchor) > HOT or anchor[0] == hot_now]))) is not None:
            yield out

    return run


def _midpoints(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)] if max_bits else np.zeros(1, np.uint64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1024):
                x = fp[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(x, len(flips)).view(np.int64))], ["mid", "fp"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) that join what is within ``max_bits``; copies of a link may occur.

    With 1 bit, midpoints also find pairs at 2 bits; these are compared and left out.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError(f"max_bits: {max_bits}")
    sent = fps.select("fp").mapInArrow(tidy(_replicate), "anchor long, fp long, home boolean")
    found = scratch.keep(sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_compare(max_bits)), "u long, v long, hot boolean"))
    hot = found.where("hot").select(F.col("u").alias("fp")).distinct().mapInArrow(tidy(_midpoints(max_bits)), "mid long, fp long")
    groups = hot.groupBy("mid").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    if max_bits == 2:  # all of a midpoint's are within 2 bits of each other: a star is enough
        more = groups.select(F.explode(F.slice("fps", 2, 65)).alias("u"), F.col("fps")[0].alias("v"))
    else:
        more = groups.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v")).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    return found.where(~F.col("hot")).select("u", "v").union(more)


def simhash_groups(docs: DataFrame, shingle: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    The component is the smallest identifier reachable over links of at most ``max_bits`` differing bits. Texts with
    fewer words than a shingle are one shingle; texts without words (null, empty) have fingerprint zero and are
    linked like any other. Repeated rows give repeated rows. A null identifier keeps its row and never names a
    component unless the component has no other. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle, id_col, text_col))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(fingerprint_links(distinct, max_bits, scratch), scratch)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only what was linked needs the second join.
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def hex64(col: Column) -> Column:
    """A long as 16 lower-case hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def simhash_keep(docs: DataFrame, shingle: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the document with the smallest identifier of each group.

    A group whose identifiers are all null keeps its rows, as do rows with a null identifier.
    """
    gone = free_name(docs, "_gone")
    drop = simhash_groups(docs, shingle, max_bits, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(drop, docs[id_col] == F.col(gone), "left_anti")
