"""Vector best-fit packing of documents into fixed-length sequences.

Pieces are told apart by their length only, so the packing is solved on the histogram of lengths (at most ``tokens``
rows, whatever the size of the corpus) and applies to all pieces at once: bins with equal residual capacities form a
group with consecutive sequence numbers, and one step places a piece of some length into many bins of a group. Each
step is one line of a placement table: the pieces of this length with ranks from ``rank`` on go to the sequences from
``sequence`` on, at ``offset``. Pieces get their ranks within a length by counting over hash buckets, which needs no
global sort and splits a length that a third of all pieces have.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces are
placed by decreasing length into the bin that has room in all three and either the largest weighted dot product of
residual and demand, or the smallest weighted norm of what is left.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch, partitions, slices, text_bytes, tidy

CACHE_WORDS = 400_000  # in each of two generations
ONCE = 1 << 22
_SINGLE = re.compile("[A-Za-z\u00df-\u00f6\u00f8-\u00ff]+")
_PUNCTUATION = b".,!?;:#$%&*|()-"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_histogram(counts: dict[int, int], tokens: int = 4096, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> list[tuple[int, int, int, int, int]]:
    """Placement lines ``(length, rank, count, sequence, offset)``.

    ``counts``: pieces of each length. ``documents`` and ``attention``: capacities of a sequence; None: what no
    sequence of ``tokens`` can exceed. A piece that alone exceeds the attention capacity is an error.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule: {rule}")
    cap = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=float)
    w = np.array(weights)
    left, size, first, used = np.empty((1024, 3)), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n_groups = n_bins = 0
    lines: list[tuple[int, int, int, int, int]] = []

    def group(residual: np.ndarray, bins: int, start: int, offset: int) -> None:
        nonlocal left, size, first, used, n_groups
        if n_groups == len(size):
            left, size, first, used = np.concatenate([left, left]), np.r_[size, size], np.r_[first, first], np.r_[used, used]
        left[n_groups], size[n_groups], first[n_groups], used[n_groups] = residual, bins, start, offset
        n_groups += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], dtype=float)
        if length < 1 or (need > cap).any():
            raise ValueError(f"no sequence has room for a piece of {length}")
        rank, n = 0, counts[length]
        while n:
            fits = np.flatnonzero((left[:n_groups] >= need).all(1))
            if not len(fits):
                # New bins, filled with as many of this length as each can take.
                each = min(int((cap // need).min()), n)
                bins = n // each
                for k in range(each):
                    lines.append((length, rank + k * bins, bins, n_bins, k * length))
                group(cap - each * need, bins, n_bins, each * length)
                rank, n, n_bins = rank + each * bins, n - each * bins, n_bins + bins
                continue
            rest = left[fits] / cap
            score = -(rest * (need / cap) * w).sum(1) if rule == "dot" else (((rest - need / cap) ** 2) * w).sum(1)
            g = fits[np.argmin(score)]
            m = min(n, int(size[g]))
            lines.append((length, rank, m, int(first[g]), int(used[g])))
            if m < size[g]:
                group(left[g] - need, m, int(first[g]), int(used[g]) + length)
                first[g], size[g] = first[g] + m, size[g] - m
            else:
                left[g] -= need
                used[g] += length
            rank, n = rank + m, n - m
        # A bin without room for one more token needs no further look.
        full = left[:n_groups, 0] < 1
        if full.mean() > 0.5:
            keep = np.flatnonzero(~full)
            left[: len(keep)], size[: len(keep)], first[: len(keep)], used[: len(keep)] = left[keep], size[keep], first[keep], used[keep]
            n_groups = len(keep)
    return lines


class _Words:
    """Ids of words as little-endian unsigned 32-bit numbers. Words met twice are kept; when the cache is full it becomes the
    old one, from which words come back when they are met again."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.once, self.n_once = bytearray(ONCE), 0
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends[k] = bool(end) and token.endswith(end)
        self.marked = bool(end)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not kept yet."""
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        if self.n_once > ONCE // 4:
            self.once, self.n_once = bytearray(ONCE), 0
        known, old, ends_in, todo = self.known, self.old, {}, set()
        for w in words:
            if w[-1] in _PUNCTUATION and b"<|" not in w:
                # Punctuation after a letter or digit is a token of its own.
                core = w.rstrip(_PUNCTUATION)
                if core[-1:].isalnum():
                    ends_in[w] = len(core)
                    todo.add(core)
                    todo.add(w[len(core) :])
                    continue
            todo.add(w)
        got: dict[bytes, bytes] = {}
        plain, rest = [], []
        for w in todo:
            if (ids := known.get(w)) is not None:
                got[w] = ids
            elif (ids := old.get(w)) is not None:
                got[w] = known[w] = ids
            # Letters of ``_SINGLE`` make one word of the tokenizer, told apart by the mark on its last token. Others may
            # become several when they are lower-cased or composed.
            elif self.marked and (w.isalpha() or _SINGLE.fullmatch(w.decode())):
                plain.append(w)
            else:
                rest.append(w)
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                got[w] = raw[at:end]
                at = end
        for k in range(0, len(rest), 1024):
            part = rest[k : k + 1024]
            for w, x in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                got[w] = np.array(x.ids, "<u4").tobytes()
        for w, n in ends_in.items():
            got[w] = got[w[:n]] + got[w[n:]]
        once, mask = self.once, ONCE - 1
        for w, ids in got.items():
            k = hash(w) & mask
            if once[k]:
                known[w] = ids
            else:
                once[k] = 1
                self.n_once += 1
        return got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get, out, new = self.known.get, [], set()
        held = []
        for t in texts:
            # The tokenizer lower-cases too, but only after it has looked for special tokens.
            words = t.split() if b"<|" in t else t.lower().split()
            ids = list(map(get, words))
            gaps, k = [], -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                gaps.append(k)
            held.append((words, ids, gaps))
            new.update([words[k] for k in gaps])
        got = self.learn(new) if new else {}
        for words, ids, gaps in held:
            for k in gaps:
                ids[k] = got[words[k]]
            out.append(b"".join(ids))
        return out


def _encode(texts: list[bytes], path: str) -> list[bytes]:
    memory = sys.__dict__.setdefault("_leafcut_words", {})  # lasts as long as the worker; functions travel by value, so a module's own names don't
    if path not in memory:
        memory[path] = _Words(path)
    return memory[path].encode(texts)


def tokenized_pieces(docs: DataFrame, path: str, tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids and a last ``end_id``; only documents longer than ``tokens`` are cut.

    The tokenizer of ``word_bpe_49k.json`` drops white space and lets no token span it, so ids are found word by word
    (words: runs of other than ASCII white space) and kept for words seen before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        last = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            docs = b.column(0).to_pylist()
            for a, z, texts in slices(b.column(1)):
                for i, ids in zip(docs[a:z], _encode(texts, path), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                        part = ids[at : at + 4 * tokens]
                        for c, v in zip(cols, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(tidy(run), PIECES)


def pack(pieces: DataFrame, scratch: Scratch, tokens: int = 4096, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """``pieces`` (with columns ``doc_id, piece, length``) and their ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    # Buckets are dealt by row and written down, so that no identifier makes a large one.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(partitions(spark))).cast("int"))
    kept = scratch.keep(pieces)
    cells = scratch.keep(kept.groupBy("bucket", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to ``tokens``
    lines = np.array(pack_histogram(counts, tokens, documents, attention, rule, weights), dtype=np.int64).reshape(-1, 5)
    lines = lines[np.lexsort((lines[:, 1], lines[:, 0]))]
    shared = spark.sparkContext.broadcast((lines[:, 0] << 48 | lines[:, 1], lines[:, 1], lines[:, 3], lines[:, 4]))

    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")
    ranked = kept.withColumn("nth", F.row_number().over(own)).join(before.select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before")), ["bucket", "length"])
    columns = [c for c in pieces.columns if c != "bucket"]
    ranked = ranked.select(*columns, (F.col("before") + F.col("nth") - 1).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = shared.value
        for b in batches:
            length = b.column(b.schema.names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.names.index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k, c in enumerate(b.schema.names) if c != "rank"), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, path: str, tokens: int = 4096, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``documents`` and ``attention`` are further capacities of a sequence; by default they are what no sequence of
    ``tokens`` can exceed, so only tokens bind.
    ``path``: the tokenizer's file, on every machine. Null text counts as empty: one piece with the end id only. Rows
    with null or repeated identifiers are packed like any other, each in a place of its own. An empty table gives an
    empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(tokenized_pieces(docs, path, tokens, id_col=id_col, text_col=text_col), scratch, tokens, documents, attention, rule, weights).withColumnRenamed("doc_id", id_col)
