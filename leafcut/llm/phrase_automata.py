"""Removal of recurring passages with sharded Aho-Corasick automata.

A window is ``window`` consecutive words of a document. Every word covered by a window whose word sequence also
starts earlier in the corpus is removed.

1. Scan. Each window names one of its ``gram``-word grams, the leftmost with the least hash (a minimizer), so equal
   windows name equal grams. Grams go to the shuffle with their places.
2. Confirm. A gram that occurs again recurs; all its places refer to the document where it stands first. A gram that a
   task meets ``LOCAL`` times or more makes no hot key: its places refer to the first one of that task's rows and do not
   meet at the gram, where only this first one goes.
3. Cut. Places come to their documents. Consecutive windows at places that others refer to make a passage; consecutive
   windows at places that refer to the same document make a stretch, which is sent to that document's passages.
4. Locate. Passages are sharded by document and cut into pieces of half a window, so that every window of a passage has
   a whole piece. The pieces of a shard are compiled into an Aho-Corasick automaton, and all its stretches stream
   through; around each piece found, passage and stretch are compared word by word to where they part. That gives every
   occurrence of a passage's windows.
5. The rest. A window may differ from the one where its gram stands first and yet recur. Windows of stretches that no
   passage covers are brought together by 128-bit digests of their words, those met twice in a task only once.
6. Removal. Covered parts come back to their documents.

Of a window's occurrences all but the first are either located at an earlier place in step 4, or the first is among
the rest of step 5 too: it is not where its gram stands first (or it would have been located), or that gram was met
``LOCAL`` times somewhere, and then the windows of its first place go along. Documents (or parts) without a recurring
gram hold no occurrence and are not streamed. 64-bit hashes only choose what meets where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch, partitions, slices, text_bytes, tidy

FLUSH = 1_000_000
LOCAL = 8
SHARD_WORDS = 200_000
REST = 200_000
_TEXT = (1 << 63) - 1  # sorts a text behind its places
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)
_JUDGED, _OWN, _HOT = 1, 2, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minimizers(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (``ends``: after each word, where its text ends): places of the grams that windows name,
    the grams' hashes, and the first and last window that name them."""
    n = len(hashes) - window + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    wide = window - gram + 1
    g = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        g = g * _ODD + hashes[k : k + len(g)]
    g = _mix(g)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, wide):
        less = g[k : k + n] < least
        np.copyto(least, g[k : k + n], where=less)
        at[less] = k
    windows = np.flatnonzero(np.arange(n) + window <= ends[:n])
    named = windows + at[windows]  # never falls, and no two texts name the same
    first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]]) if len(named) else named
    last = np.r_[first[1:], len(named)] - 1 if len(named) else named
    places = named[first]
    return places, g[places].view(np.int64), windows[first], windows[last]


def _scan(window: int, gram: int):
    names = ["sure", "key", "doc", "spot", "sub", "notice", "ref"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def out() -> pa.RecordBatch:
            nonlocal held, rows
            h, doc, spot, sub = (np.concatenate(c) for c in zip(*held, strict=True))
            held, rows = [], 0
            order = np.lexsort((spot, doc, h))
            h, doc, spot, sub = h[order], doc[order], spot[order], sub[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            many = size >= LOCAL
            sure, notice = np.repeat(many, size), np.zeros(len(h), bool)
            notice[start[many]] = True
            sure[start] = False
            # Places that are sure need not meet and are dealt out evenly.
            key = np.where(sure, _mix((doc ^ spot * 7919).view(np.uint64)).view(np.int64), h)
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (sure, key, doc, spot, sub, notice)), pa.array(np.repeat(doc[start], size), mask=~sure)], names)

        for b in batches:
            docs, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for x, y, texts in slices(b.column(2)):
                words = [t.split() for t in texts]
                n = np.fromiter(map(len, words), np.int64, y - x)
                ends = np.cumsum(n)
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) for own in words for w in own), np.uint64, int(ends[-1]))
                place, h, lo, hi = minimizers(hashes, np.repeat(ends, n), window, gram)
                of = np.searchsorted(ends, place, "right")
                spot = place - (ends - n)[of] << 16 | place - lo << 8 | place - hi
                held.append((h, docs[x:y][of], spot, subs[x:y][of]))
                rows += len(place)
                if rows >= FLUSH:
                    yield out()
        if rows:
            yield out()

    return run


def _refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of recurring grams with the document that they refer to, of a partition sorted by ``sure, key, doc, spot``.
    Holds one batch and the first place of its last gram."""
    names = ["doc", "sub", "spot", "ref", "flags"]
    open_key, first, n, hot = None, None, 0, False

    def closed() -> Iterator[pa.RecordBatch]:
        if open_key is not None and (n > 1 or hot):
            doc, sub, spot = first
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((doc, pa.int64()), (sub, pa.int64()), (spot, pa.int64()), (doc, pa.int64()), (_OWN | _HOT * hot, pa.int32()))], names)

    for b in batches:
        sure, key, doc, spot, sub, notice = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        if not len(key):
            continue
        ref, flags = b.column(6).fill_null(0).to_numpy(zero_copy_only=False).copy(), np.where(sure, _JUDGED, 0).astype(np.int32)
        at = np.flatnonzero(~sure)
        if len(at):
            k, d = key[at], doc[at]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            hots = np.logical_or.reduceat(notice[at], start)
            goes_on = open_key is not None and open_key == k[0]
            if goes_on:
                n, hot = n + int(size[0]), hot or bool(hots[0])
            if not goes_on or len(start) > 1:
                yield from closed()
            where = d[start].copy()
            if goes_on:
                where[0] = first[0]
            ref[at] = np.repeat(where, size)
            own = np.where(notice[at], _JUDGED | _OWN, _JUDGED)
            own[start] = np.where((size > 1) | hots, _OWN | _HOT * hots, 0)
            if goes_on:
                own[0] = _JUDGED | _OWN * notice[at[0]]
            if not goes_on or len(start) > 1:
                x = at[start[-1]]
                open_key, first, n, hot = int(key[x]), (int(doc[x]), int(sub[x]), int(spot[x])), int(size[-1]), bool(hots[-1])
                own[start[-1]] = 0  # told when its gram ends
            flags[at] = own
        took = flags > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[took]) for c in (doc, sub, spot, ref, flags)], names)
    yield from closed()


_CUT = "id long, doc long, sub long, n_words long, sha binary, body binary, ref long, kind int, start long, words binary, size long"
_CUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
_CUT_NAMES = [c.split()[0] for c in _CUT.split(", ")]
_PASSAGE, _HOT_PASSAGE, _STRETCH = 0, 1, 2


def _parts(spot: np.ndarray, ref: np.ndarray, flags: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``kind, ref, first word, last word + 1`` of the passages and stretches of a document."""
    order = np.lexsort((ref, spot))
    spot, ref, flags = spot[order], ref[order], flags[order]
    start = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
    flags = np.bitwise_or.reduceat(flags, start)  # rows that repeat identifier and text give a place each
    spot, ref = spot[start], ref[start]
    place = spot >> 16
    lo, hi = place - (spot >> 8 & 255), place - (spot & 255)
    for bit in (_OWN, _JUDGED):
        at = np.flatnonzero(flags & bit)
        if not len(at):
            continue
        new = lo[at][1:] != hi[at][:-1] + 1
        if bit == _JUDGED:
            new |= ref[at][1:] != ref[at][:-1]
        first = np.flatnonzero(np.r_[True, new])
        hot = np.bitwise_or.reduceat(flags[at], first) & _HOT
        for x, y, h in zip(first.tolist(), (np.r_[first[1:], len(at)] - 1).tolist(), hot.tolist(), strict=True):
            kind = _STRETCH if bit == _JUDGED else _HOT_PASSAGE if h else _PASSAGE
            yield kind, int(ref[at[x]]), int(lo[at[x]]), int(hi[at[y]]) + window


def _cut(window: int, every: bool):
    """Of a partition where each text follows its places: a row per text, and its passages and stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, size, of = [], 0, None
        for b in batches:
            doc, sub, spot, ref, flags = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            at = 0
            for t in np.flatnonzero(spot == _TEXT).tolist():
                key = (int(doc[t]), int(sub[t]))
                if key != of:
                    held, of = held if of is None else [], key
                if t > at:
                    held.append((spot[at:t], ref[at:t], flags[at:t]))
                at = t + 1
                words = b.column(6)[t].as_py().split()
                joined = b" ".join(words)
                parts = list(_parts(*(np.concatenate(c) for c in zip(*held, strict=True)), window)) if held else []
                kept = joined if every or any(p[0] == _STRETCH for p in parts) else None
                rows.append((b.column(5)[t].as_py(), *key, len(words), hashlib.sha256(joined).digest(), kept, None, None, None, None, 0))
                size += len(kept or b"") + 100
                for kind, to, x, y in parts:
                    part = b" ".join(words[x:y])
                    rows.append((None, *key, None, None, None, to if kind == _STRETCH else key[0], kind, x, part, y - x))
                    size += len(part) + 100
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CUT_TYPES, strict=True)], _CUT_NAMES)
                    rows, size = [], 0
            if at < len(spot):
                if of is not None and (int(doc[-1]), int(sub[-1])) != of:
                    held, of = [], None
                held.append((spot[at:], ref[at:], flags[at:]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CUT_TYPES, strict=True)], _CUT_NAMES)

    return run


class _Shard:
    """The passages of a shard, their word numbers, and the automaton of their pieces."""

    def __init__(self, window: int):
        self.window, self.piece = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, int, np.ndarray]] = []
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        self.automaton = None

    @staticmethod
    def letters(ids: np.ndarray) -> str:
        """A letter for each word; were there more words than letters, some would share one, which the comparison tells apart."""
        return (ids % 1_000_000 + 0xE000).astype("<u4").tobytes().decode("utf-32-le")

    def add(self, doc: int, start: int, words: list[bytes]) -> None:
        numbers = self.numbers
        ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
        s = self.letters(ids)
        for k in range(0, len(words) - self.piece + 1, self.piece):
            self.pieces.setdefault(s[k : k + self.piece], []).append((len(self.passages), k))
        self.passages.append((doc, start, ids))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, at in self.pieces.items():
            self.automaton.add_word(s, at)
        self.pieces = {}
        if len(self.automaton):
            self.automaton.make_automaton()

    def locate(self, doc: int, start: int, words: list[bytes]) -> np.ndarray:
        """Which windows of a stretch are windows of an earlier passage."""
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        window, piece = self.window, self.piece
        found = np.zeros(len(words) - window + 1, bool)
        if not len(self.automaton):
            return found
        seen: dict[tuple[int, int], int] = {}
        for end, at in self.automaton.iter(self.letters(ids)):
            q = end - piece + 1
            for p, k in at:
                shift = q - k
                if seen.get((p, shift), -1) > q:
                    continue
                of, first, own = self.passages[p]
                a, b = max(0, shift), min(len(ids), shift + len(own))
                if (of, first - shift) >= (doc, start):
                    seen[p, shift] = b
                    continue
                apart = np.flatnonzero(ids[a:b] != own[a - shift : b - shift]) + a
                k = int(np.searchsorted(apart, q))
                left = int(apart[k - 1]) + 1 if k else a
                right = int(apart[k]) if k < len(apart) else b
                seen[p, shift] = right
                if right - left >= window:
                    found[left : right - window + 1] = True
        return found


def _runs(on: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of true begin and end."""
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()


_COVERED = "d1 long, d2 long, doc long, sub long, a long, b long"


def _locate(window: int):
    """Parts of documents to remove, and (with digests) windows yet to be told, of a partition sorted by ``shard, kind``."""
    names = [c.split()[0] for c in _COVERED.split(", ")]

    def rest(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        digest = np.frombuffer(b"".join([r[0] for r in held]), np.int64).reshape(-1, 2)
        doc, sub, a = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        order = np.lexsort((a, doc, digest[:, 1], digest[:, 0]))
        digest, doc, sub, a = digest[order], doc[order], sub[order], a[order]
        start = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(1)])
        first = np.repeat(start, np.diff(np.r_[start, len(a)]))
        later = (doc != doc[first]) | (a != a[first])  # a window met before in this task
        yield pa.RecordBatch.from_arrays([*(pa.array(digest[~later, k]) for k in (0, 1)), *(pa.array(c[~later]) for c in (doc, sub, a, a + window))], names)
        none = pa.nulls(int(later.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c[later]) for c in (doc, sub, a, a + window))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for k, kind, doc, sub, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, shard = k, _Shard(window)
                words = words.split(b" ")
                if kind != _STRETCH:
                    shard.add(doc, start, words)
                    yet = np.ones(len(words) - window + 1, bool) if kind == _HOT_PASSAGE else ()
                else:
                    if shard.automaton is None:
                        shard.compile()
                    found = shard.locate(doc, start, words)
                    out += [(doc, sub, start + x, start + y - 1 + window) for x, y in zip(*_runs(found), strict=True)]
                    yet = ~found
                for x in np.flatnonzero(yet).tolist():
                    held.append((hashlib.blake2b(b" ".join(words[x : x + window]), digest_size=16).digest(), doc, sub, start + x))
                if len(held) > REST:
                    yield from rest(held)
                    held = []
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array([r[k] for r in out], pa.int64()) for k in range(4))], names)
        if held:
            yield from rest(held)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by ``d1, d2, doc, a``: the windows that also start earlier."""
    was = None  # digest and first place of the last window
    for batch in batches:
        d1, d2, doc, sub, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(d1):
            continue
        start = np.flatnonzero(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
        size = np.diff(np.r_[start, len(d1)])
        first_doc, first_a = doc[start].copy(), a[start].copy()
        if was is not None and was[0] == (d1[0], d2[0]):
            first_doc[0], first_a[0] = was[1]
        was = ((d1[-1], d2[-1]), (first_doc[-1], first_a[-1]))
        took = (doc != np.repeat(first_doc, size)) | (a != np.repeat(first_a, size))
        yield pa.RecordBatch.from_arrays([pa.array(c[took]) for c in (doc, sub, a, b)], ["doc", "sub", "a", "b"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition where each text follows its covered parts (``doc, sub, a, b, id, body``; a text's ``a`` is last)."""
    held, of = [], None
    for batch in batches:
        doc, sub, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        at = 0
        ids, n_words, removed, shas, texts = [], [], [], [], []
        for t in np.flatnonzero(a == _TEXT).tolist():
            key = (int(doc[t]), int(sub[t]))
            if key != of:
                held, of = held if of is None else [], key
            if t > at:
                held.append((a[at:t], b[at:t]))
            at = t + 1
            body = batch.column(5)[t].as_py()
            words = body.split(b" ") if body else []
            edge = np.zeros(len(words) + 1, np.int64)
            for x, y in held:
                np.add.at(edge, x, 1)
                np.add.at(edge, y, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if held else body
            ids.append(batch.column(4)[t].as_py()), n_words.append(len(words)), removed.append(int(gone.sum())), shas.append(hashlib.sha256(kept).digest()), texts.append(kept)
        if at < len(a):
            if of is not None and (int(doc[-1]), int(sub[-1])) != of:
                held, of = [], None
            held.append((a[at:], b[at:]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.binary())], ["id", "n_words", "n_removed", "sha", "kept"])


def remove_recurring(docs: DataFrame, window: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and, on demand, ``kept_text``.

    Words are runs of other than ASCII white space, unchanged; kept words are joined by one space. A window starts
    earlier in a smaller identifier, or in the same one at an earlier word. Null text has no words. A null identifier
    counts as smaller than all others. Rows that share an identifier share its places: of equal windows at equal
    places neither is the earlier. Documents shorter than a window lose nothing. An empty table gives an empty result;
    other columns are ignored. ``window`` is at most 255.
    """
    if not 0 < gram <= window < 256:
        raise ValueError(f"gram {gram} of window {window}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text_bytes(text_col).alias("body"))
    # Tells texts apart that share an identifier; short, for it goes with every gram.
    rows = rows.select("id", "doc", F.xxhash64("body").bitwiseAND(0xFFFFFFFF).alias("sub"), "body")
    scanned = rows.select("doc", "sub", "body").mapInArrow(tidy(_scan(window, gram)), "sure boolean, key long, doc long, spot long, sub long, notice boolean, ref long")
    places = scanned.repartition("key").sortWithinPartitions("sure", "key", "doc", "spot").mapInArrow(tidy(_refer), "doc long, sub long, spot long, ref long, flags int")
    places = scratch.keep(places)
    texts = rows.select("doc", "sub", F.lit(_TEXT).alias("spot"), F.lit(None).cast("long").alias("ref"), F.lit(None).cast("int").alias("flags"), "id", "body")
    both = places.select("doc", "sub", "spot", F.col("ref"), F.col("flags"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("body")).union(texts)
    cut = both.select("doc", "sub", "spot", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("flags", F.lit(0)).alias("flags"), "id", "body")
    cut = scratch.keep(cut.repartition("doc", "sub").sortWithinPartitions("doc", "sub", "spot").mapInArrow(tidy(_cut(window, with_text)), _CUT))
    scratch.drop(places)

    parts = cut.where("kind is not null")
    size = parts.where(F.col("kind") != _STRETCH).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(4 * partitions(spark), -(-size // SHARD_WORDS))
    sent = parts.select(F.pmod(F.xxhash64("ref"), F.lit(shards)).alias("shard"), "kind", "doc", "sub", "start", "words")
    covered = scratch.keep(sent.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(_locate(window)), _COVERED))
    again = covered.where("d1 is not null").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "doc", "a").mapInArrow(tidy(_later), "doc long, sub long, a long, b long")
    covered = covered.where("d1 is null").select("doc", "sub", "a", "b").union(again)

    whole = cut.where("kind is null")
    hit = covered.select("doc", "sub", "a", "b", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("body")).union(whole.where("body is not null").select("doc", "sub", F.lit(_TEXT).alias("a"), F.lit(0).cast("long").alias("b"), "id", "body"))
    done = hit.repartition("doc", "sub").sortWithinPartitions("doc", "sub", "a").mapInArrow(tidy(_remove), "id long, n_words long, n_removed long, sha binary, kept binary")
    done = done.select("id", "n_words", "n_removed", "sha", *(["kept"] if with_text else []))
    rest = whole.where("body is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", *([F.lit(None).cast("binary").alias("kept")] if with_text else []))
    out = done.union(rest)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"), *([F.col("kept").cast("string").alias("kept_text")] if with_text else []))
