"""A Brown class-based bigram model: exchange clustering, and scoring of every text with smoothed probabilities.

Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end per text are counted over all training texts. Every word
gets a class by exchange. Words with at least ``item_share`` of all tokens (so at most 1 / item_share) go first: starting
from an assignment by frequency, rounds count for each of them the classes before and after it over the whole corpus, and
move it to the class that most raises the likelihood of the class bigrams. Rounds are Spark jobs over the table of word
pairs; buckets of words are exchanged in parallel, half of the buckets in a round, the most frequent words in one bucket.
All rarer words stand together in a class meanwhile. Then each of them moves to the class that most raises the likelihood
given its own neighbours' classes (to first order, for its count is small beside the classes'): those with at least
``word_share`` by the table of pairs, the others by their places in the texts. The class bigrams are then counted again.

    P(word | before) = P(class | class before) P(word | class)

P(class | class before) is interpolated with the classes' own shares, and P(word | class) is the word's share of its class.
A further class stands for words never seen: it is counted wherever a word stands that occurs only once, beside the
word's own class. The probabilities of all words, one unseen word, and the end sum to one.

Only words with at least ``word_share`` of all tokens travel to executors. The others' classes are joined to texts that
carry a number for each word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch, each_text, slices, text_bytes

END = b"\n"  # no word has white space
FLUSH = 300_000
PAIRS_AT_ONCE = 1_000_000
BUCKETS, TOP = 16, 256
RARE, ONCE, UNSEEN = 255, 128, 127  # marks in a text's classes: joined later; the word occurs once; never seen


@dataclass
class BrownModel:
    """What scoring needs. Slots: the frequent words, the end first; class 0 holds the end only."""

    tokens: int
    distinct: int
    words: list[bytes]
    word_count: np.ndarray
    word_class: np.ndarray
    rare: DataFrame  # word binary, n long, cls int: the other words
    class_tokens: np.ndarray
    classes: int
    texts: DataFrame  # every text with its classes, see ``_resolve``
    transition: np.ndarray  # log10; the last class is that of unseen words
    objective: list[float] = field(default_factory=list)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for t in each_text(b.column(0)):
            counts.update(t.lower().split())
            counts[END] += 1
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _slots(words: list[bytes], numbers: dict[bytes, int], rare: int) -> np.ndarray:
    return np.fromiter(map(numbers.get, words, repeat(rare)), np.int64, len(words))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """The part of the log-likelihood that depends on the classes."""
    return float(_f(bigrams).sum() - _f(bigrams.sum(0)).sum() - _f(bigrams.sum(1)).sum())


def exchange(classes: np.ndarray, bigrams: np.ndarray, items: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """New classes of ``items``, moved one after another.

    left, right: for each item and class, how often the class stands before and after it; own: the item after itself.
    Class 0 holds the end only.
    """
    m, out = bigrams.astype(float), []
    before, after = m.sum(1), m.sum(0)
    for k, item in enumerate(items):
        a = classes[item]
        lf, rt, s = left[k].astype(float), right[k].astype(float), float(own[k])
        lf[a], rt[a] = lf[a] - s, rt[a] - s
        n_l, n_r = lf.sum() + s, rt.sum() + s
        m[:, a] -= lf
        m[a, :] -= rt
        m[a, a] -= s
        after[a] -= n_l
        before[a] -= n_r
        # lf and rt leave out the item itself; their places at a class count once each when the item joins it.
        i, j = np.flatnonzero(lf), np.flatnonzero(rt)
        into = _f(m[i] + lf[i, None]) - _f(m[i])
        from_ = _f(m[:, j] + rt[j]) - _f(m[:, j])
        gain = into.sum(0) + from_.sum(1)
        gain[i] -= into[np.arange(len(i)), i]
        gain[j] -= from_[j, np.arange(len(j))]
        d = np.diagonal(m)
        gain += _f(d + lf + rt + s) - _f(d)
        gain -= _f(after + n_l) - _f(after) + _f(before + n_r) - _f(before)
        gain[0] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9:
            b = int(a)
        m[:, b] += lf
        m[b, :] += rt
        m[b, b] += s
        after[b] += n_l
        before[b] += n_r
        out.append(b)
    return np.array(out, np.int64)


def fit_brown(docs: DataFrame, train: Column, scratch: Scratch, classes: int = 48, rounds: int = 8, item_share: float = 2e-5, word_share: float = 2e-6, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> BrownModel:
    """Learn from the rows of ``docs`` where ``train`` is true; the model holds all rows' classes, with ``extra`` columns."""
    spark = docs.sparkSession
    if not 2 < classes < UNSEEN:
        raise ValueError(f"classes: {classes}")
    texts = docs.where(train).select(text_bytes(text_col).alias("t"))
    counts = scratch.keep(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # At most 1 / word_share rows, for their shares sum to one.
    frequent = counts.where((F.col("n") >= word_share * total) | (F.col("word") == F.lit(END))).collect()
    frequent = sorted(((r["n"], bytes(r["word"])) for r in frequent), key=lambda x: (x[1] != END, -x[0], x[1])) or [(0, END)]
    words, word_count = [w for _, w in frequent], np.array([n for n, _ in frequent], np.int64)
    numbers = {w: k for k, w in enumerate(words)}
    rare = len(words)  # all other words
    size = rare + 1
    shared = spark.sparkContext.broadcast(numbers)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["k", "n"])

        for b in batches:
            for t in each_text(b.column(0)):
                at = np.r_[0, _slots(t.lower().split(), numbers, rare), 0]
                held.append(at[:-1] * size + at[1:])
                rows += len(at)
                if rows > PAIRS_AT_ONCE:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    pairs = scratch.keep(_split(texts.mapInArrow(pairs_of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), size))
    # Words come by frequency, so the items are the first; all others count as one item here.
    items = max(1, int((word_count >= item_share * total).sum()), 1 + int((word_count[1:] >= item_share * total).sum()))
    few = scratch.keep(_merged(pairs, items)) if items < rare else pairs

    cls = np.zeros(items + 1, np.int64)
    cls[1:items] = 1 + np.arange(items - 1) % (classes - 2)
    cls[items] = classes - 1
    bucket = np.where(np.arange(items + 1) <= TOP, 0, 1 + np.arange(items + 1) % (BUCKETS - 1))
    bucket[[0, items]] = -1  # neither the end nor the rarer words move here
    best, objective = (cls, -np.inf, None), []
    for k in range(rounds + 1):
        bigrams = _class_bigrams(few, cls, classes)
        objective.append(likelihood(bigrams))
        if objective[-1] > best[1]:
            best = (cls, objective[-1], bigrams)
        if k < rounds and total:
            cls = _round(few, cls, bigrams, bucket, k % 2, classes)
    top, _, bigrams = best
    cls = np.full(size, classes - 1)
    cls[:items] = top[:items]
    if items < rare:
        cls = _assign_pairs(pairs, cls, bigrams, items, rare)
        scratch.drop(few)
    scratch.drop(pairs, counts)

    coded = scratch.keep(_code(docs, train, words, word_count, cls, id_col, text_col, extra or {}))
    contexts = coded.where("train").select("codes", "words", "at").mapInArrow(_contexts(classes), "word binary, ctx binary")
    rare_words = scratch.keep(contexts.repartition("word").sortWithinPartitions("word").mapInArrow(_assign(bigrams), "word binary, n long, cls int"))
    class_tokens = np.bincount(cls[:rare], weights=word_count, minlength=classes)
    for r in rare_words.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # a row for each class
        class_tokens[r["cls"]] += r["n"]
    resolved = scratch.keep(_resolve(coded, rare_words))
    scratch.drop(coded)
    transition = _transition(_final_bigrams(resolved.where("text.train"), classes))
    return BrownModel(int(total), int(distinct), words, word_count, cls[:rare], rare_words, class_tokens, classes, resolved, transition, objective)


def _gather(pairs: DataFrame, keys, schema: str) -> DataFrame:
    """``keys(a, b, n)`` of the pairs, many rows at a time, summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            key, n = keys(*(np.concatenate(c) for c in zip(*held, strict=True)))
            key, at = np.unique(key, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, weights=n, minlength=len(key)).astype(np.int64))], ["k", "n"])

        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            rows += b.num_rows
            if rows > PAIRS_AT_ONCE // 2:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return pairs.mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n"))


def _split(coded: DataFrame, size: int) -> DataFrame:
    """Pairs ``a, b, n`` of ``k, n``: two words travel and are summed as one number, ``a * size + b``."""
    return coded.selectExpr(f"k div {size} AS a", f"k % {size} AS b", "n")


def _merged(pairs: DataFrame, items: int) -> DataFrame:
    """The pairs with all words from number ``items`` on as one."""
    size = items + 1
    one = _gather(pairs, lambda a, b, n: (np.minimum(a, items) * size + np.minimum(b, items), n), "k long, n long")
    return _split(one, size)


def _assign_pairs(pairs: DataFrame, cls: np.ndarray, bigrams: np.ndarray, first: int, end: int) -> np.ndarray:
    """Classes with those of the words ``first`` to ``end`` assigned by their neighbours' classes."""
    shared = pairs.sparkSession.sparkContext.broadcast(cls)
    classes = len(bigrams)
    width = 2 * classes
    gain = _gains(bigrams)

    def keys(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = shared.value
        left, right = (b >= first) & (b < end), (a >= first) & (a < end)
        return np.r_[b[left] * width + of[a[left]], a[right] * width + classes + of[b[right]]], np.r_[n[left], n[right]]

    def move(table: pa.Table) -> pa.Table:
        key, n = table.column("k").to_numpy(), table.column("n").to_numpy()
        items, at = np.unique(key // width, return_inverse=True)
        around = np.zeros((len(items), width))
        around[at, key % width] = n
        return pa.table({"item": items, "cls": np.argmax(gain(around), 1)})

    out = cls.copy()
    summed = _gather(pairs, keys, "k long, n long").withColumn("bucket", F.floor(F.col("k") / width) % 64)
    for r in summed.groupBy("bucket").applyInArrow(move, "item long, cls long").collect():  # a row for each frequent word
        out[r["item"]] = r["cls"]
    return out


def _gains(bigrams: np.ndarray):
    """What words would add to the likelihood of the class bigrams in each class, from the numbers of their neighbours'
    classes: columns of those before, then of those after."""
    n = len(bigrams)
    up = _f(bigrams + 1) - _f(bigrams)
    before, after = bigrams.sum(1), bigrams.sum(0)
    one = (_f(before + 1) - _f(before)) + (_f(after + 1) - _f(after))

    def gain(around: np.ndarray) -> np.ndarray:
        out = around[:, :n] @ up + around[:, n:] @ up.T - around[:, :n].sum(1)[:, None] * one
        out[:, 0] = -np.inf
        return out

    return gain


def _transition(bigrams: np.ndarray) -> np.ndarray:
    """Class bigrams interpolated with the classes' shares, as log10; rows sum to one."""
    n = len(bigrams)
    count = bigrams.sum(0)
    share = (count + 1) / (count.sum() + n)
    return np.log10((bigrams + n * share) / (bigrams.sum(1, keepdims=True) + n))


def _code(docs: DataFrame, train: Column, words: list[bytes], word_count: np.ndarray, cls: np.ndarray, id_col: str, text_col: str, extra: dict[str, Column]) -> DataFrame:
    """Every text as its words' classes (``RARE`` for words to be joined), its distinct rare words, and which of them
    stands at each such place; and what its frequent words add to the scores."""
    numbers = {w: k for k, w in enumerate(words)}
    code = np.r_[cls[:-1] | np.where((word_count == 1) & (np.arange(len(words)) > 0), ONCE, 0), RARE].astype(np.uint8)
    known = np.r_[word_count > 0, False]
    plus, log = np.r_[np.log10(word_count + 1.0), 0.0], np.r_[np.log10(np.maximum(word_count, 1)), 0.0]
    log[0] = 0  # the end is all of its class
    shared = docs.sparkSession.sparkContext.broadcast((numbers, code, known, plus, log))
    names = ["row", "codes", "n_known", "plus", "log", "words", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, code, known, plus, log = shared.value
        rare = len(numbers)
        for b in batches:
            kind = (b.schema.field(0).type, pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary())
            rows, held, first = [], 0, 0
            for k, t in enumerate(each_text(b.column(1))):
                own = t.lower().split()
                slot = np.r_[_slots(own, numbers, rare), 0]
                order: dict[bytes, int] = {}
                at = [order.setdefault(own[x], len(order)) for x in np.flatnonzero(slot == rare).tolist()]
                rows.append((code[slot].tobytes(), int(known[slot].sum()), float(plus[slot].sum()), float(log[slot].sum()), list(order), np.array(at, np.int32).tobytes()))
                held += len(own)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind[1:], strict=True))], names)
                    rows, held, first = [], 0, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind[1:], strict=True))], names)

    # Row numbers are written down before anything is joined to them.
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), train.alias("train"), *(c.alias(f"x_{k}") for k, c in extra.items())).alias("row"), text_bytes(text_col).alias("t"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, codes binary, n_known long, plus double, log double, words array<binary>, at binary"
    return rows.mapInArrow(run, schema).withColumn("train", F.col("row.train"))


def _contexts(classes: int):
    """Each rare word with the classes before and after its places in many texts, two bytes for a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        held: list[tuple] = []
        rows = 0

        def out() -> pa.RecordBatch:
            word, around = np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(word, kind="stable")
            ends = 2 * np.cumsum(np.bincount(word, minlength=len(numbers)))
            ctx = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(around[order]))])
            return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.binary()), ctx], ["word", "ctx"])

        for b in batches:
            for codes, words, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not words:
                    continue
                seq = np.frombuffer(codes, np.uint8)
                place = np.flatnonzero(seq == RARE)
                seq = np.where(seq == RARE, classes - 1, seq & (ONCE - 1)).astype(np.uint8)
                own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                # Every text ends, so a word has one after it; before the first stands an end.
                held.append((own[np.frombuffer(at, np.int32)], np.stack([np.where(place > 0, seq[place - 1], 0), seq[place + 1]], 1).astype(np.uint8)))
                rows += len(place)
                if rows > PAIRS_AT_ONCE:
                    yield out()
                    numbers.clear()
                    held, rows = [], 0
        if held:
            yield out()

    return run


def _assign(bigrams: np.ndarray):
    """Counts and classes of rare words, of a partition sorted by word."""
    n, gains = len(bigrams), _gains(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, carried = None, np.zeros((1, 2 * n))

        def out(words: list[bytes], around: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(around[:, :n].sum(1).astype(np.int64)), pa.array(np.argmax(gains(around), 1).astype(np.int32))], ["word", "n", "cls"])

        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                part = b.slice(k, 20_000)
                words, ctx = part.column(0).to_pylist(), part.column(1).to_pylist()
                of, distinct = np.empty(len(words), np.int64), []
                for j, w in enumerate(words):
                    if not distinct or distinct[-1] != w:
                        distinct.append(w)
                    of[j] = len(distinct) - 1
                of = np.repeat(of, [len(c) // 2 for c in ctx])
                raw = np.frombuffer(b"".join(ctx), np.uint8).reshape(-1, 2).astype(np.int64)
                around = sum(np.bincount(of * 2 * n + side * n + raw[:, side], minlength=len(distinct) * 2 * n) for side in (0, 1)).reshape(-1, 2 * n).astype(float)
                if carry is not None:
                    if carry == distinct[0]:
                        around[0] += carried[0]
                    else:
                        yield out([carry], carried)
                carry, carried = distinct[-1], around[-1:]
                if len(distinct) > 1:
                    yield out(distinct[:-1], around[:-1])
        if carry is not None:
            yield out([carry], carried)

    return run


def _resolve(coded: DataFrame, rare: DataFrame) -> DataFrame:
    """``text, codes, n_known, plus, log``: every text with all its words' classes, ``UNSEEN`` for words without one."""
    parts = ["text", "codes", "n_known", "plus", "log", "at"]
    own = F.struct(F.col("row").alias("text"), *parts[1:])
    kind = coded.select(own.alias("t")).schema["t"].dataType
    # A word's row: where it stands in its text's list, and its count and class in one number. Each word stands once in
    # ``rare``, so hash tables of it need no sorting of the texts' words.
    met = coded.select(F.col("row.row").alias("row"), F.posexplode("words").alias("k", "word")).join(rare.hint("shuffle_hash"), "word")
    met = met.select("row", "k", (F.col("n") * 256 + F.col("cls")).alias("v"), F.lit(None).cast(kind).alias("t"))
    whole = coded.select(F.col("row.row").alias("row"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("v"), own.alias("t"))

    def resolved(k: np.ndarray, v: np.ndarray, text: tuple) -> tuple:
        codes, n_known, plus, log, at = text
        at = np.frombuffer(at, np.int32)
        if not len(at):
            return codes, n_known, plus, log
        seq = np.frombuffer(codes, np.uint8).copy()
        n = v >> 8
        times, code = np.zeros(at.max() + 1, np.int64), np.full(at.max() + 1, UNSEEN, np.int64)
        times[k], code[k] = n, v & 255 | np.where(n == 1, ONCE, 0)
        times = times[at]
        seq[seq == RARE] = code[at]
        return seq.tobytes(), n_known + int((times > 0).sum()), plus + float(np.log10(times + 1.0).sum()), log + float(np.log10(np.maximum(times, 1)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, text, name = None, [], None, None  # of the text whose rows may go on

        def out(rows: list[tuple], names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(names), *(pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True))], parts[:5])

        def closed() -> tuple:
            k, v = (np.concatenate(c) for c in zip(*held, strict=True))
            return resolved(k[k >= 0], v[k >= 0], text)

        for b in batches:
            row, k, v = (b.column(c).to_numpy() for c in range(3))
            if not len(row):
                continue
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            texts = np.flatnonzero(k < 0)
            t = b.column(3).take(pa.array(texts))
            fields = list(zip(*(t.field(c).to_pylist() for c in range(1, 6)), strict=True))
            of = np.searchsorted(start, texts, "right") - 1
            there = dict(zip(of.tolist(), range(len(texts)), strict=True))
            rows, names = [], []
            for g, (x, y) in enumerate(zip(start.tolist(), [*start[1:].tolist(), len(row)], strict=True)):
                if row[x] != now:
                    if now is not None:
                        rows.append(closed())
                        names.append(name)
                    now, held, text, name = row[x], [], None, None
                held.append((k[x:y], v[x:y]))
                if (j := there.get(g)) is not None:
                    text, name = fields[j], t.field(0).slice(j, 1)
            if rows:
                yield out(rows, names)
        if now is not None:
            yield out([closed()], [name])

    schema = f"text {coded.schema['row'].dataType.simpleString()}, codes binary, n_known long, plus double, log double"
    # One number to sort by; within a text any order will do.
    return met.union(whole).repartition("row").sortWithinPartitions("row").mapInArrow(run, schema)


def _final_bigrams(resolved: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams over all texts, with the class of unseen words wherever a word stands that occurs once."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k, np.int64)
        for b in batches:
            for _, _, texts in slices(b.column(0)):
                seq = np.r_[np.uint8(0), np.frombuffer(b"".join(texts), np.uint8)]  # each text ends with the end, as if another came before it
                once = seq >= ONCE
                seq = (seq & (ONCE - 1)).astype(np.int64)
                a, c = seq[:-1], seq[1:]
                for key in (a * k + c, a[once[1:]] * k + classes, classes * k + c[once[:-1]]):
                    out += np.bincount(key, minlength=k * k)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["k", "n"])

    out = np.zeros(k * k)
    for r in resolved.select("codes").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # classes squared rows
        out[r["k"]] = r["n"]
    return out.reshape(k, k)


def _class_bigrams(pairs: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    shared = pairs.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes, np.int64)
        for b in batches:
            a, c, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            out += np.bincount(shared.value[a] * classes + shared.value[c], weights=n, minlength=len(out)).astype(np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["k", "n"])

    out = np.zeros(classes * classes)
    for r in pairs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # classes squared rows
        out[r["k"]] = r["n"]
    return out.reshape(classes, classes)


def _round(pairs: DataFrame, cls: np.ndarray, bigrams: np.ndarray, bucket: np.ndarray, parity: int, classes: int) -> np.ndarray:
    """Classes after the buckets of this parity were exchanged."""
    shared = pairs.sparkSession.sparkContext.broadcast((cls, bigrams, bucket))
    width = 2 * classes + 1

    def keys(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls, _, bucket = shared.value
        moves = (bucket >= 0) & (bucket % 2 == parity)
        left, right = moves[b], moves[a]
        same = right & (a == b)
        return np.r_[b[left] * width + cls[a[left]], a[right] * width + classes + cls[b[right]], a[same] * width + 2 * classes], np.r_[n[left], n[right], n[same]]

    def move(table: pa.Table) -> pa.Table:
        cls, bigrams, _ = shared.value
        key, n = table.column("k").to_numpy(), table.column("n").to_numpy()
        items, at = np.unique(key // width, return_inverse=True)
        dense = np.zeros((len(items), width), np.int64)
        dense[at, key % width] = n
        by_count = np.argsort(-dense[:, :classes].sum(1), kind="stable")
        items, dense = items[by_count], dense[by_count]
        new = exchange(cls, bigrams, items, dense[:, :classes], dense[:, classes:-1], dense[:, -1])
        return pa.table({"item": items, "cls": new})

    item = F.floor(F.col("k") / width)
    buckets = F.when(item <= TOP, 0).otherwise(1 + item % (BUCKETS - 1))
    summed = _gather(pairs, keys, "k long, n long").withColumn("bucket", buckets)
    out = cls.copy()
    for r in summed.groupBy("bucket").applyInArrow(move, "item long, cls long").collect():  # a row for each item
        out[r["item"]] = r["cls"]
    return out


def score_brown(model: BrownModel, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row that the model was made with, and its
    ``extra`` columns."""
    k = model.classes + 1
    # Of a word: its share of its class; of unseen words, whose class is the last here: one.
    share = np.r_[0.0, np.log10(np.maximum(model.class_tokens[1:], 1)), 0.0]
    base = float(np.log10(float(model.tokens + model.distinct + 1)))
    transition = model.transition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_tokens, base_score, score = (np.empty(b.num_rows, t) for t in (np.int64, float, float))
            plus, log = (b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            for x, y, texts in slices(b.column(1)):
                n = np.array([len(t) for t in texts])
                seq = np.frombuffer(b"".join(texts), np.uint8) & (ONCE - 1)
                seq = np.where(seq == UNSEEN, k - 1, seq).astype(np.int64)
                each = transition[np.r_[0, seq[:-1]], seq] - share[seq]  # a text before ends with the end
                n_tokens[x:y], base_score[x:y] = n, plus[x:y] - n * base
                score[x:y] = log[x:y] + np.add.reduceat(each, np.r_[0, np.cumsum(n)[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens), b.column(2), pa.array(base_score), pa.array(score)], ["text", "n_tokens", "n_known", "base_score", "score"])

    kind = model.texts.schema["text"].dataType
    out = model.texts.select("text", "codes", "n_known", "plus", "log").mapInArrow(run, f"text {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    extra = [c for c in kind.names if c.startswith("x_")]
    return out.select(F.col("text.id").alias(id_col), *(F.col(f"text.{c}").alias(c[2:]) for c in extra), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def brown_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Fit on the rows where ``train`` is true and score all: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Null text counts as empty: one token, the end. Null ``train`` counts as true. Repeated rows are counted and scored
    each by itself. Without training rows all words are unseen. An empty table gives an empty result; other columns
    are ignored.
    """
    train = F.coalesce(train, F.lit(True))
    model = fit_brown(docs, train, Scratch(docs.sparkSession, "brown"), id_col=id_col, text_col=text_col, extra={"held_out": ~train}, **fit)
    out = score_brown(model, id_col)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
