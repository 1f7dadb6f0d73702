"""Near duplicates by SimHash and, exactly, by the Jaccard similarity of word shingles.

SimHash fingerprints are linked through anchors first (``simhash_anchors``), and each link is held against the
similarity. That leaves out near copies whose fingerprints lie further apart, so a join finds all others:

A text is the set of its shingles' 64-bit hashes. Sets of ``n`` and more hashes whose similarity is at least ``t`` share
one of the first ``n - ceil(t n) + 1`` hashes of each, in any order that all sets follow (prefix filter). The order puts
hashes that many texts have last, so common lines seldom stand in a prefix; it decides the work, not the result.

Hashes of prefixes that several sets share are keys. Pairs under a key are left out if their sizes differ too much, or
if the parities of their hashes in ``BITS`` buckets, then in about as many buckets as they have hashes, differ more often
than the sets may; these bounds are exact. The rest is compared in full, first each set with one other, then only pairs that are not yet in one component. Under keys of
more than ``FEW`` sets, all are first compared with a few of them. The others are compared only across components:
first each set with the nearest one of another component, so that a large group of near copies grows together with a row
per set and key, and then with all that the bounds still allow. A pair that meets under several such keys is taken up
under the first of them, as far as the ``LOWS`` first keys of its sets tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.llm.components import connected_components
from leafcut.llm.shared import Scratch, each_text, free_name, slices, text_bytes, tidy
from leafcut.llm.simhash_anchors import fingerprint, fingerprint_links

FEW = 32
PIVOTS = 4
LOWS = 8
BITS = 512
WIDE = 2048
MARKS = 1 << 22
CHUNK = 1_000_000
HUB_SHARE, HUB_PAIRS, SALTS = 0.001, 64, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1
FIRST, NEAREST, ALL = range(3)
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted hashes of the text's shingles; lower-cases A-Z. A text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1 if k else 0
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = (s ^ h[j : j + n]) * _ODD
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _parity(s: np.ndarray, bits: int = BITS) -> bytes:
    """Whether each bucket holds an odd number of hashes."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def _common(k: int):
    """Hashes that several of some texts of a task have, and of how many: ``h, c``."""

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], ["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in each_text(b.column(0)):
                held.append(shingles(t, k))
                size += len(held[-1])
                if size > CHUNK:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    return run


def _prefixes(k: int, t: Fraction, common):
    """A row ``id, node, mark, n, parity, fp`` per text (fp: the SimHash, once in a task for a set), and a row ``key, node`` per hash of a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level = common.value
        seen: set[int] = set()
        names = ["key", "id", "node", "mark", "n", "parity", "fp"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        for b in batches:
            for x, y, texts in slices(b.column(2)):
                rows, keys, nodes = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for i, mark, text in zip(b.column(0)[x:y].to_pylist(), b.column(1)[x:y].to_pylist(), texts, strict=True):
                    s = shingles(text, k)
                    node = _node(s)
                    new = len(s) and node not in seen
                    fp = int(np.uint64(fingerprint(text.lower().split(), k)).view(np.int64)) if new else None
                    rows.append((None, i, node, mark, len(s), _parity(s), fp))
                    if not new:
                        continue
                    seen.add(node)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        s = s[np.argsort(np.where(hashes[at] == s, level[at], 0), kind="stable")]
                    keys.append(s[: len(s) + 1 - -(-t.numerator * len(s) // t.denominator)])
                    nodes.append(np.full(len(keys[-1]), node))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(types)], names)
                key = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), types[1]), pa.array(np.concatenate(nodes)), *(pa.nulls(len(key), kind) for kind in types[3:])], names)

    return run


def _by_key(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """``work`` on the rows of whole keys of a sorted partition, many keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if held and (cut or held[-1].column(0)[-1].as_py() != key[-1]):
                yield from work(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, b = [], b.slice(cut)
            elif cut:
                yield from work(pa.Table.from_batches([b.slice(0, cut)]))
                b = b.slice(cut)
            held.append(b)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return start, np.diff(np.r_[start, len(key)])


def _shared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of keys with several sets, without repeated ones, and whether these are many; rows are sorted by key and node."""
    key, node = (rows.column(c).to_numpy() for c in (0, 1))
    once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node = key[once], node[once]
    start, size = _starts(key)
    of = np.repeat(size > 1, size)
    yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(node[of]), pa.array(np.repeat(size > FEW, size)[of])], ["key", "node", "large"])


def _pairs(t: Fraction, step: int):
    """Pairs ``u, v`` under a key, of two components, that the bounds allow. FIRST: all of small keys, and those with a
    few sets of large ones. NEAREST: under large keys, each set outside the largest component with the nearest. ALL: all of large keys."""
    p, q = t.numerator, t.denominator

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, n, root = (rows.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2, 4))
        parity = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        lows = None if step == FIRST else pa.concat_arrays([c.flatten() for c in rows.column(5).chunks]).to_numpy().reshape(-1, LOWS)
        us, vs, held = [], [], 0

        def out() -> pa.RecordBatch:
            found = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_PAIR)

        for a, m in zip(*(x.tolist() for x in _starts(key)), strict=True):
            if step != FIRST:
                _, group, count = np.unique(root[a : a + m], return_inverse=True, return_counts=True)
                if m <= FEW or len(count) == 1:
                    continue
                left = a + np.flatnonzero(group != np.argmax(count))
            elif m > FEW:
                left = a + np.argsort(node[a : a + m].view(np.uint64) * _ODD)[:PIVOTS]  # the same under all keys of a group
            else:
                left = np.arange(a, a + m)
            for x in left.tolist():
                far = np.bitwise_count(parity[a : a + m] ^ parity[x]).sum(1, dtype=np.int64)
                both, own = n[a : a + m] + n[x], n[a : a + m]
                ok = ((p + q) * far <= (q - p) * both) & (q * np.minimum(own, n[x]) >= p * np.maximum(own, n[x])) & (root[a : a + m] != root[x])
                at = np.flatnonzero(ok)
                if step != FIRST and len(at):
                    at = at[~np.isin(lows[a + at], lows[x][lows[x] < key[x]]).any(1)]  # the others meet under an earlier key
                    if step == NEAREST and len(at):
                        at = at[[np.argmin(far[at] / both[at])]]
                us.append(np.minimum(node[a + at], node[x]))
                vs.append(np.maximum(node[a + at], node[x]))
                held += len(at)
                if held > CHUNK:
                    yield out()
                    us, vs, held = [], [], 0
        if us:
            yield out()

    return run


def _sets(k: int, marks, whole: bool):
    """``node, n, data`` of texts whose mark is wanted, once in a task; data: the hashes (``whole``) or their parities."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows, size = [], 0
            for x in np.flatnonzero(marks.value[b.column(0).to_numpy()]).tolist():
                s = shingles(b.column(1)[x].as_py(), k)
                if (node := _node(s)) not in seen:
                    seen.add(node)
                    rows.append((node, len(s), s.tobytes() if whole else _parity(s, max(WIDE, 1 << (len(s) - 1).bit_length()))))
                    size += len(rows[-1][2])
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

    return run


def _near(t: Fraction):
    """Pairs that the wide parities allow; the longer of two is folded to the shorter."""

    def far(x: bytes, y: bytes) -> int:
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.array([far(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)], np.int64)
            ok = (t.denominator + t.numerator) * apart <= (t.denominator - t.numerator) * b.column(2).to_numpy()
            yield b.select([0, 1]).filter(pa.array(ok))

    return run


def _similar(t: Fraction):
    """Of a partition sorted by ``u, salt, v`` with nulls first: the pairs whose sets are similar. ``u``'s own set comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for b in batches:
            us, vs = [], []
            for u, v, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                y = np.frombuffer(raw.as_buffer(), np.uint64)
                if v is None:
                    x = y.copy()
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                if t.denominator * same >= t.numerator * (len(x) + len(y) - same):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_PAIR)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction, scratch: Scratch) -> DataFrame:
    """The similar ones of ``pairs``. The set of ``v`` goes to ``u``; a ``u`` with a share of all pairs (at most
    1 / HUB_SHARE have it) and over ``HUB_PAIRS`` is met in several tasks."""
    times = scratch.keep(pairs.groupBy("u").agg(F.count("*").alias("n")))
    least = max(HUB_PAIRS, HUB_SHARE * (times.agg(F.sum("n")).first()[0] or 0))
    hubs = F.broadcast(times.where(F.col("n") > least).select("u", F.lit(SALTS).alias("salts")))
    salt = F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")
    others = pairs.join(hubs, "u", "left").select("u", salt.alias("salt"), "v").join(sets.select(F.col("node").alias("v"), "hashes"), "v").select("u", "salt", "v", "hashes")
    salts = F.explode(F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    own = sets.select(F.col("node").alias("u"), "hashes").join(times, "u").select("u", salts.alias("salt"), F.lit(None).cast("long").alias("v"), "hashes")
    rows = others.union(own).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    found = scratch.keep(rows.mapInArrow(tidy(_similar(t)), "u long, v long"))
    scratch.drop(times)
    return found


def _anchored(nodes: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """Pairs ``u, v`` by SimHash: sets of one fingerprint with the first of them, and those of linked fingerprints."""
    some = nodes.where("fp IS NOT NULL")
    fps = scratch.keep(some.groupBy("fp").agg(F.min("node").alias("first")))
    of_u, of_v = (fps.select(F.col("fp").alias(c), F.col("first").alias(f"f{c}")) for c in "uv")
    ends = fingerprint_links(fps, max_bits, scratch).join(of_u, "u").join(of_v, "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    alike = some.join(fps, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return scratch.keep(alike.union(ends).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def jaccard_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for each row: the smallest identifier reachable over texts of at least that similarity.

    Texts without words (null, empty) are alike. Repeated rows give repeated rows. A null identifier keeps its row and
    names no component unless it has no other. An empty table gives an empty result; other columns are ignored.
    max_bits: of SimHash links (0 to 2); it decides the work, not the result.
    """
    t = Fraction(similarity).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError(f"similarity: {similarity}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    body = text_bytes(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).bitwiseAND(MARKS - 1).cast("int").alias("mark"), body.alias("t"))
    # A share of all rows, so that the list does not grow with the table.
    many = texts.select("t").mapInArrow(tidy(_common(shingle)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > 30 + docs.count() // 5000).toArrow()
    h = many.column("h").to_numpy().view(np.uint64)
    by_hash = np.argsort(h)
    common = spark.sparkContext.broadcast((h[by_hash], np.log2(np.maximum(many.column("c").to_numpy(), 1)).astype(np.int64)[by_hash]))
    sent = scratch.keep(texts.mapInArrow(tidy(_prefixes(shingle, t, common)), "key long, id long, node long, mark int, n int, parity binary, fp long"))
    rows = scratch.keep(sent.where("key IS NULL").select("id", "node"))
    nodes = scratch.keep(sent.where("key IS NULL").groupBy("node").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.max("fp").alias("fp")))
    keys = sent.where("key IS NOT NULL").select("key", "node")
    shared = scratch.keep(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(_by_key(_shared)), "key long, node long, large boolean"))
    scratch.drop(sent)
    def of(pairs: DataFrame, whole: bool) -> DataFrame:
        """Sets or their sketches of all that stand in ``pairs``."""
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "mark"), "node")
        marks = np.zeros(MARKS, bool)
        marks[wanted.select("mark").distinct().toArrow().column(0).to_numpy()] = True
        got = texts.select("mark", "t").mapInArrow(tidy(_sets(shingle, spark.sparkContext.broadcast(marks), whole)), "node long, n long, data binary")
        return scratch.keep(got.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """A component stands for its sets; what is found from here on joins components."""
        return rows.join(roots, rows.node == roots.node, "left").select(*(rows[c] for c in rows.columns), F.coalesce("root", rows.node).alias("root"))

    def links(rows: DataFrame, step: int) -> DataFrame:
        rows = rows.select("key", "node", "n", "parity", "root", *(["lows"] if step != FIRST else []))
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_by_key(_pairs(t, step))), "u long, v long")
        found = scratch.keep(found.distinct())
        sketch = of(found, False)
        wide = [sketch.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("data").alias(f"w{c}")) for c in "uv"]
        near = found.join(wide[0], "u").join(wide[1], "v").selectExpr("u", "v", "nu + nv AS n", "wu", "wv").mapInArrow(tidy(_near(t)), "u long, v long")
        near = scratch.keep(near)
        scratch.drop(sketch, found)
        sets = of(near, True).select("node", F.col("data").alias("hashes"))
        if step != FIRST:
            return _verified(near, sets, t, scratch)
        one = anchored.union(_verified(near.groupBy("v").agg(F.min("u").alias("u")), sets, t, scratch))
        joined = connected_components(one, scratch)
        of_u, of_v = (joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
        apart = near.join(of_u, "u", "left").join(of_v, "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
        return one.union(_verified(scratch.keep(apart), sets, t, scratch))

    pairs = _anchored(nodes, max_bits, scratch)
    anchored = _verified(pairs, of(pairs, True).select("node", F.col("data").alias("hashes")), t, scratch)
    lows = shared.where("large").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("lows"))
    none = F.array_repeat(F.lit(_LAST).cast("long"), LOWS)
    sets = nodes.join(lows, "node", "left").select("node", "n", "parity", F.slice(F.concat(F.coalesce("lows", F.array().cast("array<long>")), none), 1, LOWS).alias("lows"))
    full = scratch.keep(shared.join(sets, "node").select("key", "node", "n", "parity", "lows"))
    scratch.drop(shared)
    known = links(rooted(full, connected_components(anchored, scratch)), FIRST)
    roots = connected_components(known, scratch)
    for step in (NEAREST, ALL):
        more = links(rooted(full, roots), step)
        if not more.isEmpty():
            known = known.union(more)
            roots = connected_components(known, scratch)
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def jaccard_keep(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the document with the smallest identifier of each group.

    A group whose identifiers are all null keeps its rows, as do rows with a null identifier.
    """
    gone = free_name(docs, "_gone")
    drop = jaccard_groups(docs, shingle, similarity, max_bits, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(drop, docs[id_col] == F.col(gone), "left_anti")
