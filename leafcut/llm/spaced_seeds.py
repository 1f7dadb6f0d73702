"""Benchmark decontamination with spaced seeds.

Words are compared with A-Z lower-cased and ASCII punctuation taken as white space. A seed is a fixed mask over
consecutive words that ignores some positions; the words at the others are hashed. Hashes of benchmark and training
texts are joined, and around every hit the two texts are laid side by side. An overlap is a stretch of ``min_words`` words
or more (or the whole of a shorter item) of which at least ``identity`` are equal, whatever lies beside it.

For overlaps of 12 to 20 words with up to a fifth of them substituted, anywhere, some mask skips the substitutions (all
patterns were tried). Items shorter than the widest mask's reach have seeds of their own: cut into one part more than they
may have substitutions, one part of a copy is whole, whatever its length.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words; a block's hashes go to the executors, and every block is
a pass over the texts. The texts are not shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import slices, text_bytes, tidy

MASKS = ("111111", "1110111", "11011011", "110100111", "1010011011", "11001010011")  # six words each
SHORT = 12  # words; of items below, masks miss some substitutions
BLOCK_WORDS = 1_000_000
AT_ONCE = 2_000_000
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
_ODD = np.uint64(0x9E3779B97F4A7C15)
HITS = "item_id long, n_words int, n_equal int, doc_start int, item_start int"


def _seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a mask's seeds; number 0 stands for a word that matches nothing."""
    on = [k for k, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids > 0
    good = known[on[0] : on[0] + n].copy()
    for k in on[1:]:
        good &= known[k : k + n]
    at = np.flatnonzero(good)
    h = np.zeros(len(at), np.uint64)
    for k in on:
        h = (h ^ ids[at + k].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return at, h


class Block:
    """The items of a block, their word numbers, and their seeds by hash."""

    def __init__(self, items: list[tuple[int | None, bytes]], min_words: int, identity: float):
        self.min_words, self.identity = min_words, Fraction(identity).limit_denominator(1000)
        p, q = self.identity.numerator, self.identity.denominator
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def add(mask: str, item: int, ids: np.ndarray, start: int) -> None:
            at, h = _seeds(ids, mask)
            seeds.setdefault(mask, []).append((h, np.full(len(at), item), at + start))

        for item, text in items:
            words = text.translate(_FOLD).split()
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            if len(ids) < SHORT:
                parts = len(ids) - -(-p * len(ids) // q) + 1
                cuts = [k * len(ids) // parts for k in range(parts + 1)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    add("1" * (y - x), len(self.items), ids[x:y], x)
            else:
                for mask in MASKS:
                    add(mask, len(self.items), ids, 0)
            self.items.append((item, ids))
        self.seeds = {}
        for mask, found in seeds.items():
            h, item, at = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            if len(keys):
                self.seeds[mask] = (keys, np.r_[first, len(h)], item[order], at[order])
        self.longest = max((len(ids) for _, ids in self.items), default=0)

    def overlap(self, a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int] | None:
        """Start, words and equal words of the best overlap of two texts side by side: of the stretches with ``least`` words
        or more and ``identity``, the one with most equal words, the shortest of these, the first of these."""
        at = np.flatnonzero(a == b)
        if not len(at) or len(a) < least:
            return None
        p, q = self.identity.numerator, self.identity.denominator
        count = np.arange(len(at))
        score = q * count - p * at
        # The last place from which the score does not fall too low is the end of the longest overlap from each start.
        most = np.maximum.accumulate(score[::-1])
        last = len(at) - 1 - np.searchsorted(most, score - (q - p))
        # Equal words that lie closer may have different ones beside them.
        near = np.searchsorted(at, at + least) - 1
        last = np.where((at[last] - at + 1 < least) | (near > last), near, last)
        same, n = last - count + 1, np.maximum(at[last] - at + 1, least)
        fit = np.flatnonzero(q * same >= p * n)
        if not len(fit):
            return None
        start = np.minimum(at, len(a) - n)
        k = fit[np.lexsort((start[fit], n[fit], -same[fit]))[0]]
        return int(start[k]), int(n[k]), int(same[k])

    def search(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text its overlaps: item, words, equal words, start in the text, start in the item."""
        gap, parts, first = max(map(len, MASKS)), [], []
        at = 0
        number = self.numbers.get
        for t in texts:
            ids = np.array([number(w, 0) for w in t.translate(_FOLD).split()], np.int64)
            first.append(at)
            parts += [ids, np.zeros(gap, np.int64)]
            at += len(ids) + gap
        found: list[list[tuple]] = [[] for _ in texts]
        if not texts or not self.seeds:
            return found
        ids, starts = np.concatenate(parts), np.array(first)
        # A diagonal: text, item, and how far the one is shifted against the other.
        wide = max(map(len, parts)) + self.longest + 1
        diagonals = np.empty(0, np.int64)
        for mask, (keys, bounds, items, places) in self.seeds.items():
            place, h = _seeds(ids, mask)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == h)
            k, place = k[hit], place[hit]
            doc = np.searchsorted(starts, place, "right") - 1
            times = bounds[k + 1] - bounds[k]
            # Of texts and items that repeat themselves, few at a time meet.
            batch = (np.cumsum(times) - times) // AT_ONCE
            cuts = np.searchsorted(batch, np.unique(batch))
            for x, y in zip(cuts, np.r_[cuts, len(times)][1:], strict=True):
                n = times[x:y]
                of = np.repeat(np.arange(x, y), n)
                row = np.repeat(bounds[k[x:y]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                shift = place[of] - starts[doc[of]] - places[row] + self.longest
                diagonals = np.unique(np.r_[diagonals, (doc[of] * len(self.items) + items[row]) * wide + shift])
        best: dict[tuple[int, int], tuple] = {}
        for code in diagonals.tolist():
            code, shift = divmod(code, wide)
            (d, i), shift = divmod(code, len(self.items)), shift - self.longest
            item, own = self.items[i]
            text = parts[2 * d]
            a, b = max(0, -shift), min(len(own), len(text) - shift)
            if (got := self.overlap(own[a:b], text[a + shift : b + shift], min(self.min_words, len(own)))) is None:
                continue
            start, n, same = got
            if (d, i) not in best or same > best[d, i][2]:
                best[d, i] = (item, n, same, a + start + shift, a + start)
        for (d, _), row in sorted(best.items()):
            found[d].append(row)
        return found


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items of each block, read one after another; items without words are left out."""
    held: list[tuple] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), text_bytes(text_col).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = len(r["t"].split())
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        if n:
            held.append((r["i"], bytes(r["t"])))
            size += n
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and benchmark item that overlap, and none for clean documents:
    ``doc_id, item_id, n_words, n_equal, doc_start, item_start, contaminated``; the overlap with most equal words.

    Null texts and items count as empty and overlap nothing. Repeated rows of ``docs`` give repeated rows; repeated items
    with one identifier give one. Null identifiers are kept. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for block in blocks_of(benchmark, block_words=block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Block(shared.value, min_words, identity)
            for b in batches:
                ids = b.column(0).to_pylist()
                for x, y, texts in slices(b.column(1)):
                    rows = [(i, *r) for i, found in zip(ids[x:y], index.search(texts), strict=True) for r in _one_each(found)]
                    types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "item_id", "n_words", "n_equal", "doc_start", "item_start"])

        got = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(tidy(run), f"id long, {HITS}")
        out = got if out is None else out.union(got)
    if out is None:
        out = spark.createDataFrame([], f"id long, {HITS}")
    return out.withColumn("contaminated", F.lit(True)).withColumnRenamed("id", id_col)


def _one_each(found: list[tuple]) -> list[tuple]:
    """Of overlaps with the same item identifier, the first with most equal words."""
    best: dict = {}
    for r in found:
        if r[0] not in best or r[2] > best[r[0]][2]:
            best[r[0]] = r
    return list(best.values())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, identity: float = 0.8, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns.

    Null texts overlap nothing and stay, as do null identifiers; repeated rows stay or go together. An empty table gives
    an empty result, an empty benchmark leaves all rows.
    """
    k = docs.columns.index(text_col)
    for block in blocks_of(benchmark, block_words=block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Block(shared.value, min_words, identity)
            for b in batches:
                clean = [not found for _, _, texts in slices(b.column(k)) for found in index.search(texts)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
