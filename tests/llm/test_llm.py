"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import same_rows
from pyspark.sql import functions as F

from leafcut.llm import components, jaccard_join, phrase_automata, simhash_anchors, warc_chunks
from leafcut.llm.bloom_cascade import build_cascade, url_verdicts
from leafcut.llm.brown_lm import BrownModel, _split, brown_scores, exchange, fit_brown, likelihood, score_brown
from leafcut.llm.components import connected_components
from leafcut.llm.content_sort import content_sort_dedup, content_sort_keep
from leafcut.llm.jaccard_join import jaccard_keep
from leafcut.llm.ordinal_toxicity import drop_toxic, fit_ordinal, fit_toxicity, toxicity_scores
from leafcut.llm.phrase_automata import remove_recurring
from leafcut.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from leafcut.llm.rule_ensemble import quality_scores
from leafcut.llm.shared import Scratch
from leafcut.llm.simhash_anchors import fingerprint, fingerprint_links, simhash_groups, simhash_keep
from leafcut.llm.spaced_seeds import Block, contaminated, drop_contaminated
from leafcut.llm.vector_packing import pack_documents, pack_histogram
from leafcut.llm.warc_chunks import archive_bytes, plan_records, read_chunks, warc_round_trip, write_chunks

CLASH = ", _gone string, id long, t string, fp long, lead string, hash string, body string, row int, piece int, label double, key string, gram string"


def documents(spark, rows):
    """rows: (doc_id, text); further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "?", -1, "x", 5, "l", "h", "b", 9, 8, 0.5, "k", "g") for i, t in rows], "doc_id long, text string" + CLASH)


@pytest.fixture(scope="module")
def edge():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    base = [rng.choice(words) for _ in range(60)]
    rows = [(None, "null id"), (None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, long), (6, long), (7, "One"), (7, "One"), (8, "same\x00 text \u00e9 <|endoftext|>"), (9, "same\x00 text \u00e9 <|endoftext|>")]
    rows += [(10 + k, " ".join(base[:k] + ["new%d" % k] + base[k:])) for k in range(20, 30)]
    rows += [(40, " ".join(base)), (41, "  ".join(base) + "\n"), (42, " ".join(base[5:45])), (43, "the " * 100), (44, "x the " * 60)]
    return rows


def test_content_sort(spark, edge):
    for keep, best in (("largest", max), ("smallest", min)):
        got = content_sort_dedup(documents(spark, edge), keep=keep).toPandas()
        groups = {}
        for i, t in edge:
            groups.setdefault(t or "", []).append(i)
        assert len(got) == len(edge)
        for t, ids in groups.items():
            part = got[got.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            known = [i for i in ids if i is not None]
            assert len(part) == len(ids) and set(part.group_size) == {len(ids)} and part.kept.sum() == 1
            if known:
                assert set(part.keep_id) == {best(known)} and part[part.kept].doc_id.iloc[0] == best(known)
        kept = content_sort_keep(documents(spark, edge), keep=keep)
        assert kept.count() == len(groups) and kept.columns == documents(spark, edge).columns


def test_content_sort_over_seams(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, "hot" if k % 3 else f"t{k}") for k in range(600)]
        got = content_sort_dedup(documents(spark, rows).repartition(7)).toPandas()
        hot = got[got.group_size > 1]
        assert len(hot) == 400 and set(hot.keep_id) == {1} and hot.kept.sum() == 1 and set(hot.group_size) == {400}
        assert content_sort_keep(documents(spark, rows)).count() == 201
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, bits):
    top = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                top = [top[j] if x == top[i] else x for x in top] if top[i] != top[j] else top
    return top


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash(spark, edge, bits):
    rows = [(i, t) for i, t in edge if i is not None]
    got = simhash_groups(documents(spark, rows), shingle=3, max_bits=bits).toPandas()
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    top = components_of(fps, bits)
    least = {c: min(i for (i, _), x in zip(rows, top) if x == c) for c in top}
    want = sorted((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, top))
    assert sorted(map(tuple, got[["doc_id", "fingerprint", "component_id"]].values.tolist())) == want
    assert simhash_keep(documents(spark, rows), 3, bits).select("doc_id").distinct().count() == len(set(least.values()))


@pytest.mark.parametrize("hot", [2, 10_000])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_lose_nothing(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(simhash_anchors, "HOT", hot)
    monkeypatch.setattr(components, "ONE_TASK", 0 if hot == 2 else 1 << 20)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark, "t")
    roots = dict(connected_components(fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, scratch), scratch).collect())
    top = components_of(fps, bits)
    for a in range(len(fps)):
        for b in range(a):
            assert (top[a] == top[b]) == (roots.get(signed[a], signed[a]) == roots.get(signed[b], signed[b]))


def test_fingerprint_of_long_text():
    words = [b"w%d" % (k % 700) for k in range(20000)]
    assert fingerprint(words, 3) == plain_fingerprint(" ".join(w.decode() for w in words), 3)


def plain_removal(rows, window):
    seen, out = {}, {}
    ordered = sorted(((-(1 << 63) if i is None else i, t, i) for i, t in rows), key=lambda r: r[0])
    texts = [(d, (t or "").encode().split(), i) for d, t, i in ordered]
    for d, w, _ in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            seen[k] = min(seen.get(k, (d, s)), (d, s))
    for d, w, i in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("hot", [2, 8])
def test_phrases(spark, edge, monkeypatch, hot):
    monkeypatch.setattr(phrase_automata, "LOCAL", hot)
    for window, gram in ((20, 8), (5, 3), (4, 4)):
        got = remove_recurring(documents(spark, edge), window, gram, with_text=True).toPandas()
        want = plain_removal(edge, window)
        assert len(got) == len(edge)
        for i, own in want.items():
            part = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
            assert sorted(map(tuple, part[["n_words", "n_removed", "kept_sha256", "kept_text"]].values.tolist())) == sorted(own), (window, i)


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = pack_documents(documents(spark, edge), tokenizer_path(), tokens=512).toPandas()
    want = Counter()
    for i, t in edge:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    have = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.values == np.cumsum(part.length.values) - part.length.values).all() and part.length.sum() <= 512


def test_tokens_of_any_text():
    from tokenizers import Tokenizer

    from leafcut.llm.vector_packing import _Words

    tok, words, rng = Tokenizer.from_file(tokenizer_path()), _Words(tokenizer_path()), random.Random(12)
    texts = ["Visit \u0130stanbul today", "\u0928\u093c \u0930\u093c \u0958 \u0915\u094d\u0937", "e\u0301te\u0301 \u1e9e \ufb01x \u03a3\u03a3. \u03a3", "a<|endoftext|>B <|pad|> C", "x\u00a0y\u3000z\u2028w\x85v\x1cu", "\ud55c\uad6d\uc5b4 \u4e2d\u6587, \U0001f600!a\u200d", ""]
    pools = [[chr(rng.randrange(32, 0x3000)) for _ in range(80)], [chr(rng.randrange(0x10000, 0x1FFFF)) for _ in range(20)], list("abcXYZ019.,!?;:#$%&*|()-<|>\t\n ")]
    for _ in range(3000):
        texts.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(40))))
    for got, t in zip(words.encode([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_capacities(rule):
    rng = random.Random(1)
    counts = Counter(min(100, int(rng.expovariate(1 / 20)) + 1) for _ in range(3000))
    counts[100] += 1000
    lines = pack_histogram(counts, 100, documents=5, attention=10_000, rule=rule)
    bins, placed = {}, Counter()
    for length, rank, n, seq, offset in lines:
        placed[length] += n
        for k in range(n):
            bins.setdefault(seq + k, []).append((offset, length))
    assert placed == counts
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= 100 and len(own) <= 5 and sum(x * x for _, x in own) <= 10_000
    total = sum(k * v for k, v in counts.items())
    assert len(bins) <= 1.25 * max(total / 100, sum(counts.values()) / 5)
    assert pack_histogram({}, 10) == []
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


@pytest.mark.parametrize("hot", [1, 1000])
def test_warc(spark, monkeypatch, hot):
    monkeypatch.setattr(warc_chunks, "HOT_ROWS", hot)
    big = "<p>" + "é" * 5000 + "</p>"
    huge = "<h>" * 30_000
    rows = [(20, "u", huge + "1"), (20, "v", huge + "2"), (None, "n", huge + "3"), (None, None, huge + "4"), (21, "w", huge), (21, "w", huge), (22, "w", huge), (5, "http://a/ b", big), (3, None, big), (9, "http://c/", None), (1, "http://d/", "x" * 99), (2, "http://e/", "x" * 99), (4, "u", "y" * 100), (6, "u", "y" * 100), (6, "u", "y" * 100), (7, "u", "WARC/1.1\r\n\r\n" * 20), (None, "n", "z" * 500)]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, id int, payload string")
    got = warc_round_trip(pages, Scratch(spark, "t"), chunk_bytes=1000).toPandas()
    assert got.intact.all() and len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got[got.page_id.notna()].itertuples():
        body = next((h or "") for i, _, h in rows if i == r.page_id and (i != 20 or hashlib.sha256(h.encode()).hexdigest() == r.payload_digest)).encode()
        again = len(body) >= 100 and first[body.decode()] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.record_type == ("revisit" if again else "response") and (r.refers_to == first[body.decode()] if again else np.isnan(r.refers_to))
    assert Counter(got.payload_digest) == Counter(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows)
    chunks = Scratch(spark, "t").keep(write_chunks(plan_records(pages, Scratch(spark, "t")), 1000))
    raw = b"".join(archive_bytes(chunks))
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == len(rows) and big.encode() in raw
    page3 = next(r.record for r in read_chunks(chunks).where("page = 3").collect())
    broken = chunks.withColumn("data", F.when(F.col("record") == page3, F.concat("data", F.lit("!").cast("binary"))).otherwise(F.col("data")))
    assert [r.record for r in read_chunks(broken).where("not intact").collect()] == [page3]
    lost = chunks.where((F.col("chunk") != 0) | (F.col("record") != next(r.record for r in read_chunks(chunks).where("page = 22 or page = 21").where("record_type = 'response'").collect())))
    assert read_chunks(lost).where("not intact and page is null").count() == 1 and read_chunks(lost).count() == len(rows)
    assert warc_round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_cascade(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) AS key")
    listed = universe.where("key like '%7'")
    cascade = build_cascade(listed, universe, Scratch(spark, "t"))
    assert len(cascade.levels) >= 2
    wrong = universe.where(cascade.holds(F.col("key")) != F.col("key").like("%7"))
    assert wrong.count() == 0
    assert universe.where(build_cascade(listed.limit(0), universe, Scratch(spark, "t")).holds(F.col("key"))).count() == 0


def test_cascade_of_all_and_of_others(spark):
    universe = spark.range(50).selectExpr("concat('k', id) AS key")
    all_listed = build_cascade(universe, universe, Scratch(spark, "t"))
    assert universe.where(all_listed.holds(F.col("key"))).count() == 50
    foreign = build_cascade(spark.range(50).selectExpr("concat('x', id) AS key").union(universe.limit(0)), universe, Scratch(spark, "t"))
    assert universe.where(foreign.holds(F.col("key"))).count() == 0


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    tail = rest[len(host) :]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = host.lower()
    fits = [(-len(h + p), h + p, v != "block", v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return (host, path, *((best[1], best[3]) if best else (None, "allow")))


def test_many_rules(spark):
    rng = random.Random(10)
    hosts = [".".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) + ".com" for _ in range(60)]
    rules = [(rng.choice(hosts), "/" + "".join(rng.choice("xy") for _ in range(rng.randrange(200))), rng.choice(["allow", "block"])) for _ in range(10_000)]
    rules += [(h, "/x", "allow") for h in hosts] + [(h, "/x", "block") for h in hosts[:30]]
    urls = [f"https://{rng.choice('zw')}.{h}{p}{rng.choice(['', '?q', '/more' * 3000])}" for h, p, _ in rng.sample(rules, 30)] + [f"http://{rng.choice(hosts)}/x{k % 3}" for k in range(10)]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")
    for bits in (1 << 23, 40_000):
        began = time.time()
        got = [tuple(r) for r in url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_bits=bits).collect()]
        assert sorted(got, key=str) == sorted([(k, *plain_verdict(u, rules)) for k, u in [*enumerate(urls), (0, urls[0])]], key=str)
        assert time.time() - began < 120


@pytest.mark.parametrize("bits", [1 << 23, 20])
def test_urls(spark, bits):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("net", "/de/", "allow"), ("net", "/de/", "block"), (None, "/x", "block")]
    urls = ["http://EXAMPLE.com/en/77?x#y", "https://a.Example.com/en/7", "x://notexample.com/en/7", "http://com/en/", "http://.com/en/z", "http://b.net/de/q", "http://b.net", None, "no scheme/en/", "http://", "http://x.com?/en/", "a://b://com/en/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_bits=bits).toPandas().set_index("page_id")
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        tail = rest[len(host) :]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: (x[0], x[2] == "block"), default=None)
        r = got.loc[k]
        assert (r.host, r.path) == (host, path)
        assert (r["rule"], r.verdict) == ((best[1], best[2]) if best else (None, "allow")), u
    assert url_verdicts(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    n, c = 40, 6
    pairs = rng.poisson(1, (n, n)) + 20 * (np.add.outer(np.arange(n), np.arange(n)) % 2)
    pairs[0] = pairs[:, 0] = 1

    def tables(cls):
        one = np.eye(c)[cls]
        return one.T @ pairs @ one, pairs.T @ one, pairs @ one

    cls = np.r_[0, 1 + np.arange(n - 1) % (c - 1)]
    before = likelihood(tables(cls)[0])
    for item in range(1, n):
        bigrams, left, right = tables(cls)
        was = likelihood(bigrams)
        cls[item] = exchange(cls, bigrams, np.array([item]), left[[item]], right[[item]], pairs[[item], [item]])[0]
        assert likelihood(tables(cls)[0]) >= was - 1e-6
    assert likelihood(tables(cls)[0]) > before + 100


def plain_brown(texts, train, classes, word_class):
    """log10 probabilities of texts from the classes of words, by the model's own rule."""
    toks = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    count = Counter(w for t, own in zip(toks, train) if own for w in t)
    of = {w: (0 if w == b"\n" else word_class[w]) for w in count}
    k, two, size = classes + 1, Counter(), Counter()
    for w, n in count.items():
        size[of[w]] += n
    for t, own in zip(toks, train):
        for a, b in zip([b"\n", *t], t) if own else ():
            two[of[a], of[b]] += 1
            if count[b] == 1 and b != b"\n":
                two[of[a], classes] += 1
            if count[a] == 1 and a != b"\n":
                two[classes, of[b]] += 1
    col = [sum(two[a, b] for a in range(k)) for b in range(k)]
    row = [sum(two[a, b] for b in range(k)) for a in range(k)]
    p = lambda a, b: (two[a, b] + k * (col[b] + 1) / (sum(col) + k)) / (row[a] + k)
    cls = lambda w: of.get(w, classes)
    return [sum(np.log10(p(cls(a), cls(b)) * (count[b] / size[of[b]] if b in of and b != b"\n" else 1)) for a, b in zip([b"\n", *t], t)) for t in toks]


@pytest.mark.parametrize(("share", "items"), [(0.002, 0.002), (0.02, 0.02), (0.002, 0.01)])
def test_brown(spark, edge, share, items):
    docs = documents(spark, edge)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = fit_brown(docs, F.coalesce(train, F.lit(True)), Scratch(spark, "t"), classes=5, rounds=2, word_share=share, item_share=items)
    rare = {bytes(r.word): (r.n, r.cls) for r in model.rare.collect()}
    word_class = dict(zip(model.words, model.word_class.tolist())) | {w: c for w, (_, c) in rare.items()}
    c = Counter()
    for i, t in edge:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), b"\n"])
    assert set(word_class) == set(c) and all(c[w] == n for w, (n, _) in rare.items()) and (share < 0.01 or rare)
    n, v = sum(c.values()), len(c)
    score = plain_brown([t for _, t in edge], [not held(i) for i, _ in edge], 5, word_class)
    want = sorted((str(i), held(i), len(w), sum(x in c for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(s, 6)) for (i, t), s in zip(edge, score) for w in [[*(t or "").encode().lower().split(), b"\n"]])
    for got in (brown_scores(docs, train, classes=5, rounds=2, word_share=share, item_share=items), score_brown(model).withColumn("held_out", F.coalesce(~train, F.lit(False)))):
        have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
        assert have == want
    assert brown_scores(docs.limit(0), train).count() == 0
    assert {r.n_known for r in brown_scores(docs, F.lit(False)).collect()} == {0}


def test_brown_pairs_travel_as_one_number(spark):
    size = 500_001
    pairs = {(0, 0), (0, size - 1), (size - 1, 0), (size - 1, size - 1), (1, 2), (2, 1)}
    coded = spark.createDataFrame([(a * size + b, 3) for a, b in pairs], "k long, n long")
    assert {(r.a, r.b, r.n) for r in _split(coded, size).collect()} == {(a, b, 3) for a, b in pairs}


def test_brown_sums_to_one(spark):
    docs = documents(spark, list(enumerate(["a b a b c", "a b rare1", "c c a rare2 rare3"])))
    m: BrownModel = fit_brown(docs, F.lit(True), Scratch(spark, "t"), classes=4, rounds=2, word_share=0.15)
    assert np.allclose((10**m.transition).sum(1), 1) and m.transition.shape == (5, 5)
    size = np.bincount(m.word_class, weights=m.word_count, minlength=4)
    for r in m.rare.collect():
        size[r.cls] += r.n
    assert (size == m.class_tokens).all() and size.sum() == m.tokens and size[0] == 3


def test_brown_assigns_rare_words_by_their_neighbours(spark):
    rng = random.Random(9)
    nouns, verbs = [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    texts = [" ".join(w for _ in range(30) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(60)]
    texts += [f"{rng.choice(verbs)} rareness{k} {rng.choice(verbs)} {rng.choice(nouns)} oddity{k} {rng.choice(nouns)}" for k in range(20)]
    m = fit_brown(documents(spark, list(enumerate(texts))), F.lit(True), Scratch(spark, "t"), classes=4, rounds=6, word_share=0.005, item_share=0.005)
    of = dict(zip(m.words, m.word_class.tolist())) | {bytes(r.word): r.cls for r in m.rare.collect()}
    noun, verb = (Counter(of[w.encode()] for w in own).most_common(1)[0][0] for own in (nouns, verbs))
    assert noun != verb
    assert sum(of[b"rareness%d" % k] != verb for k in range(20)) >= 18 and sum(of[b"oddity%d" % k] != noun for k in range(20)) >= 18


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        bad = k % 8 == 0
        words = [rng.choice("alpha beta gamma delta of the and to".split()) for _ in range(60)]
        if bad:
            for p in rng.sample(range(60), 2 + k // 8 % 6):
                words[p] = rng.choice(["Vile,", "nastyish"])
        rows.append((k, " ".join(words) + ("." if k % 3 else "!!! ###")))
        labels.append((k, int(k % 3 != 0), int(bad)))
    return documents(spark, [*rows, (None, None), (900, "")]), spark.createDataFrame(labels + labels[:5] + [(None, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels)
    got = toxicity_scores(docs, model).toPandas().set_index("doc_id")
    for k in range(400):
        assert got.loc[k].toxic == (k % 8 == 0), k
    assert got[got.toxic].expected_severity.min() > got[~got.toxic].expected_severity.max()
    assert (np.diff(model.thresholds) > 0).all()
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 402 - 50
    blind = fit_toxicity(docs, labels.where("toxic = 0"))
    assert not toxicity_scores(docs, blind).where("toxic").count()
    assert toxicity_scores(docs.limit(0), fit_toxicity(docs.limit(0), labels)).count() == 0


def test_ordinal_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    s = x @ [2.0, -1.0] + rng.logistic(size=2000)
    w, t = fit_ordinal(x, np.digitize(s, [-1.0, 0.5, 2.0]), 4)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(t, [-1, 0.5, 2], atol=0.3)


def test_quality(spark):
    docs, labels = labelled(spark)
    scored, model = quality_scores(docs, labels, F.col("doc_id") % 5 != 0)
    got = scored.toPandas().set_index("doc_id")
    held = [k for k in range(400) if k % 5 == 0]
    assert np.mean([got.loc[k].predicted == int(k % 3 != 0) for k in held]) > 0.95
    assert got.score.between(0, 1).all() and len(got) == 402 and model.rules
    nothing, _ = quality_scores(docs, labels.limit(0), F.lit(True))
    assert set(nothing.toPandas().score) == {0.5}
    assert quality_scores(docs.limit(0), labels, F.lit(True))[0].count() == 0


def plain_statistics(t):
    """The statistics of a text by plain means, in the order of the module's."""
    import regex

    t = t or ""
    n, count = max(len(t), 1), lambda p: len(regex.findall(p, t))
    words, lines = count(r"[^\x20\x09-\x0D]+"), [x for x in t.split("\n") if x]
    space = r"[\x20\x09-\x0D]"
    return [
        len(t), words, len(t) / max(words, 1), count(r"\p{Lu}") / n, sum(c in "#$%&*+<=>@\\^_`|~{}[]" for c in t) / n, t.count("!") / n, sum(c in "0123456789" for c in t) / n, count(r"\p{L}") / n,
        count(rf"[.?](?={space}|$)") / max(words, 1), t.count(",") / max(words, 1), count(rf"[^\x20\x09-\x0D\p{{L}}\p{{N}}]{{2,}}(?={space}|$)") / max(words, 1), words / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(len(w) <= 3 for w in regex.split(rf"{space}+", t) if w) / max(words, 1),
    ]


def test_quality_against_plain_rules(spark):
    docs, labels = labelled(spark)
    odd = ["One, two. THREE!! four?? -- (five)\nsix\nsix\n\n7 8#9", "\u00c9t\u00e9 na\u00efve. " * 400, None, "", "a!!! b... c"]
    docs = docs.union(documents(spark, [(1000 + k, t) for k, t in enumerate(odd)])).union(documents(spark, [(1000, odd[0])]))
    scored, model = quality_scores(docs, labels, F.col("doc_id") % 5 != 0)
    from leafcut.llm.rule_ensemble import NAMES, with_statistics

    assert with_statistics(docs, "text", []).columns == NAMES == model.names
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    x = np.array([plain_statistics(t) for _, t in rows], float)
    want = sorted((str(i), round(float(p), 6), int(p >= 0.3)) for (i, _), p in zip(rows, model.predict(x)))
    assert sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in scored.collect()) == want


def test_sample_of_repeated_identifiers(spark):
    from leafcut.llm.rule_ensemble import labelled_sample

    docs = documents(spark, [(1, "a"), (1, "b"), (1, None), (2, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", "doc_id", "text", 10).count() == 2


def plain_toxicity(text, model):
    """P(grade >= 1), expected severity and grade by plain loops over words."""
    table = {c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
    words = "".join(table.get(c, c.lower() if c.isascii() else c) for c in text or "").encode().split()
    score = 0.0
    for f, w in zip(model.features, model.weights):
        f = f.decode()
        n = sum(t == f or (f[:1] == "^" and len(f) - 1 in range(3, 9) and t[: len(f) - 1] == f[1:]) for t in (x.decode() for x in words))
        score += w * np.log1p(n)
    above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
    each = [a - b for a, b in zip([1, *above], [*above, 0])]
    return above[0], sum(above), int(np.argmax(each))


def test_toxicity_against_plain_scores(spark):
    docs, labels = labelled(spark)
    long = "Vile, of the " * 7000
    docs = docs.union(documents(spark, [(2000, long), (2000, long), (2001, "VILE! nastyish\u00e9 na\u00efve vile-nasty")]))
    model = fit_toxicity(docs, labels)
    assert model.features
    for r, (i, t) in zip(sorted(toxicity_scores(docs, model).collect(), key=lambda r: str(r.doc_id)), sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: str(r[0])), strict=True):
        p, severity, grade = plain_toxicity(t, model)
        assert r.doc_id == i and np.allclose((r.p_toxic, r.expected_severity), (p, severity)) and r.grade == grade and r.toxic == (p >= 0.5), i


def test_pipeline_stages_against_plain_ones(spark, sf):
    """Each stage on rows with nulls, repeats, ties and columns that clash, held against plain versions."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    item = [str(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text.split()]
    rows = [(None, "null id here"), (None, "null id here"), (1, None), (2, ""), (3, " \n"), (5, "one"), (5, "one"), (6, "One")]
    for k in range(30):
        base = [rng.choice(words) for _ in range(60)]
        rows.append((10 + 3 * k, " ".join(base)))
        if k % 3 == 0:
            rows.append((11 + 3 * k, " ".join(base)))
        if k % 3 == 1:
            rows.append((11 + 3 * k, " ".join([*base[:-1], "other"])))
        if k % 5 == 0:
            rows.append((12 + 3 * k, " ".join(base[:20] + item + [rng.choice(words) for _ in range(40)])))
    rows.append((900, " ".join(rng.choice(words) for _ in range(20_000))))
    docs = documents(spark, rows)
    ids = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    kept = P.toxicity(spark, docs, sf)
    model = fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns
    assert ids(kept) == sorted(((i, t) for i, t in rows if plain_toxicity(t, model)[0] < 0.5), key=str)

    kept = P.exact_dedup(spark, docs, sf)
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", i)
    assert kept.columns == docs.columns and sorted(((i, t or "") for i, t in ids(kept)), key=str) == sorted(((i, t) for t, i in first.items()), key=str)

    plain = [(i, t) for t, i in first.items()]
    near = P.near_dedup(spark, documents(spark, plain), sf)
    known = [(i, t) for i, t in plain if i is not None]
    assert near.columns == docs.columns and {i for i, _ in ids(near)} == plain_jaccard(known) | {None}

    clean = P.decontamination(spark, docs, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    fold = lambda t: "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c.lower() if c.isascii() else c for c in t or "").encode().split()
    own = [(k, fold(t)) for k, (_, t) in enumerate(rows) if len(t or "") < 5000]
    near_items = [(j, fold(t)) for j, t in bench if set(fold(t)) & {w for _, own_words in own for w in own_words}]
    bad = {k for k, _ in plain_contaminated(own, near_items)}
    assert bad and clean.columns == docs.columns and ids(clean) == sorted(((i, t) for k, (i, t) in enumerate(rows) if k not in bad), key=str)

    tok = Tokenizer.from_file(tokenizer_path())
    packed = P.packing(spark, docs, sf).toPandas()
    want = Counter()
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, k, min(4096, n - a)) for k, a in enumerate(range(0, n, 4096)))
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.length) for r in packed.itertuples()) == want
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.values == np.cumsum(part.length.values) - part.length.values).all() and part.length.sum() <= 4096
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_seeds(spark):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(2000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (40, 25, 15, 13, 6)] + [["The", "A."] * 10]
    rows, want = [], set()
    for k in range(60):
        body = text(200)
        item = items[k % 5]
        kind = k % 4
        if kind:
            part = [w.upper() + "," for w in item]
            if kind == 2 and len(part) > 12:  # every seventh word is another
                part = ["zz" if p % 7 == 6 else w for p, w in enumerate(part)]
            if kind == 3:
                part = part[: 9 if len(part) > 9 else 4]  # too little to count
            else:
                want.add((k, k % 5))
            body[50:50] = part
        rows.append((k, " ".join(body)))
    docs = documents(spark, [*rows, (900, None), (901, "")])
    bench = spark.createDataFrame([*((k, " ".join(x), "a") for k, x in enumerate(items)), (50, None, "b"), (None, " ", "c")], "item_id long, text string, id string")
    for block in (1_000_000, 30):
        got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench, block_words=block).collect()}
        assert got == want
        kept = {r.doc_id for r in drop_contaminated(docs, bench, block_words=block).collect()}
        assert kept == ({*range(60), 900, 901} - {d for d, _ in want})
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_empty_tables(spark):
    none = documents(spark, [])
    assert content_sort_dedup(none).count() == content_sort_keep(none).count() == simhash_groups(none).count() == simhash_keep(none).count() == 0
    assert remove_recurring(none).count() == pack_documents(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).fetch_df())


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        if name == "exact_dedup":
            assert kept.count() == kept.select("text").distinct().count()
    packed = P.packing(spark, kept, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()} == {r.doc_id for r in P.run(spark, sf).collect()}


def plain_jaccard(rows, k=5, least=0.8):
    """Which rows stay; rows: (doc_id, text) with distinct identifiers."""
    sets, top, holders = {}, {i: i for i, _ in rows}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, own in sets.items():
        met = Counter(b for s in own for b in holders[s] if b < a)
        for b, same in met.items():
            if same >= least * (len(own) + len(sets[b]) - same):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return {i for i in sets if root(i) == i}


@pytest.mark.parametrize("few", [2, 32])
def test_jaccard(spark, edge, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", few)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, t) for i, t in dict(edge).items() if i is not None]
    line = [rng.choice(words) for _ in range(12)]
    for k in range(6):
        base = [rng.choice(words) for _ in range(40 + 50 * k)]
        for j in range(40):
            own = line + base
            for _ in range(rng.randrange(2 + 2 * k)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 40 * k + j, " ".join(own)))
    want = plain_jaccard(rows)
    assert 10 < len(want) < len(rows) - 50
    docs = documents(spark, rows + rows[:3] + [(None, rows[-1][1])])
    kept = jaccard_keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_pipeline_near(spark, sf):
    import corpus_pipeline as P

    docs = P.exact_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).cache()
    base = [f"word{k}" for k in range(100)]
    more = [(10**9 + k, " ".join(base[:at] + ["other"] + base[at + 1 :])) for k, at in enumerate((50, 10, 98))]  # 0.83 to 0.95 to each other or over another
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()}
    assert kept == plain_jaccard(rows) and len(rows) - len(kept) >= 2


def test_near_stage_links_by_simhash(spark, monkeypatch, sf):
    import corpus_pipeline as P
    from leafcut.llm.simhash_anchors import fingerprint

    calls, real = [], jaccard_join._anchored

    def spy(nodes, max_bits, scratch):
        pairs = real(nodes, max_bits, scratch)
        calls.append((max_bits, [(r.node, r.fp) for r in nodes.collect()], [(r.u, r.v) for r in pairs.collect()]))
        return pairs

    monkeypatch.setattr(jaccard_join, "_anchored", spy)
    rng = random.Random(31)
    words = [f"w{k}" for k in range(3000)]
    rows = [(0, None), (1, " "), (2, "one")]
    for k in range(12):
        base = [rng.choice(words) for _ in range(900)]
        rows += [(10 * k + 10 + j, " ".join([*base[:-1], f"other{j}"])) for j in range(4)]
    kept = {r.doc_id for r in P.near_dedup(spark, documents(spark, rows), sf).collect()}
    assert kept == plain_jaccard(rows)
    [(bits, nodes, pairs)] = calls
    fps = {f & (1 << 64) - 1 for _, f in nodes if f is not None}
    assert bits == 2 and fps == {fingerprint(t.encode().split(), 5) for _, t in rows if t and t.split()}
    of = {n: f for n, f in nodes}
    assert pairs and all((of[u] ^ of[v]).bit_count() <= 2 for u, v in pairs)

    def parts(links):
        top = {n: n for n, f in nodes if f is not None}
        for _ in top:
            for u, v in links:
                top[u] = top[v] = min(top[u], top[v])
        return top

    assert parts(pairs) == parts([(u, v) for u in of for v in of if u < v and None not in (of[u], of[v]) and ((of[u] ^ of[v]) & (1 << 64) - 1).bit_count() <= 2])


def test_large_keys_make_no_square(spark):
    """60 sets that all look alike meet under 20 keys: a row for a set and key, then each pair once."""
    import pyarrow as pa
    from fractions import Fraction

    keys, sets = 20, 60
    lows = list(range(jaccard_join.LOWS))
    columns = [np.repeat(np.arange(keys), sets), np.tile(np.arange(sets), keys), np.full(keys * sets, 100), [bytes(jaccard_join.BITS // 8)] * (keys * sets), np.tile(np.arange(sets), keys), [lows] * (keys * sets)]
    rows = pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], list("abcdef"))
    made = {}
    for step in (jaccard_join.NEAREST, jaccard_join.ALL):
        made[step] = [tuple(r.values()) for key in range(keys) for b in jaccard_join._pairs(Fraction(4, 5), step)(rows.filter(pa.array(columns[0] == key))) for r in b.to_pylist()]
    assert 0 < len(made[jaccard_join.NEAREST]) <= keys * sets
    assert sorted(made[jaccard_join.ALL]) == [(u, v) for u in range(sets) for v in range(u + 1, sets)]


def plain_overlap(equal, least):
    """Start, words and equal words of the best stretch of ``least`` words or more with 0.8 of them equal."""
    n = len(equal)
    fits = [(sum(equal[x:y]), x - y, -x) for x in range(n) for y in range(x + least, n + 1) if 5 * sum(equal[x:y]) >= 4 * (y - x)]
    return max(fits, default=None)


def test_overlaps_are_whole():
    rng = random.Random(6)
    block = Block([], 12, 0.8)
    for n in (11, 12, 13, 20, 40):
        for share in (0.7, 0.8, 0.9):
            for _ in range(40):
                equal = [rng.random() < share for _ in range(n)]
                best = plain_overlap(equal, 12)
                got = block.overlap(np.zeros(n), np.array([0 if e else 1 for e in equal]), 12)
                assert (got is None) == (best is None)
                if got:  # of stretches with as many equal words any may be the shortest, but not a longer one
                    start, words, same = got
                    assert (same, -words) == best[:2] and sum(equal[start : start + words]) == same


def plain_contaminated(docs, items, least=12):
    """All pairs, all alignments, all stretches."""
    out = set()
    for i, text in docs:
        for j, item in items:
            for shift in range(-len(item) + 1, len(text)):
                a, b = max(0, -shift), min(len(item), len(text) - shift)
                if plain_overlap([item[k] == text[k + shift] for k in range(a, b)], min(least, len(item))):
                    out.add((i, j))
                    break
    return out


def test_no_overlap_is_lost(spark):
    rng = random.Random(15)
    words = [f"v{k}" for k in range(150)]
    items = [(n, [rng.choice(words) for _ in range(n)]) for n in range(1, 22)] + [(30, ["ho"] * 13), (31, ["a", "b", "c"] * 6)]
    docs = []
    for k in range(120):
        _, item = rng.choice(items)
        part = [w if rng.random() > 0.2 else rng.choice(words) for w in item]
        docs.append((k, [rng.choice(words) for _ in range(10)] + part + [rng.choice(words) for _ in range(rng.randrange(20))]))
    docs += [(200, ["ho"] * 40), (201, ["ho"] * 11), (202, ["c", "a", "b"] * 5), (203, ["a", "b", "c", "x"] * 5)]
    want = plain_contaminated(docs, items)
    assert 30 < len(want) < len(docs) * len(items) // 2
    table = documents(spark, [(i, " ".join(t)) for i, t in docs])
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(table, bench).collect()} == want
    assert {r.doc_id for r in drop_contaminated(table, bench, block_words=50).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_substitutions_of_every_place():
    """Copies with up to a fifth of their words substituted, alone among other words."""
    rng = random.Random(16)
    for n in (1, 4, 5, 6, 9, 10, 11, 12, 13, 15, 20, 30):
        item = [f"i{k}" for k in range(n)]
        block = Block([(1, " ".join(item).encode())], 12, 0.8)
        texts = []
        for _ in range(200):
            gone = set(rng.sample(range(n), n // 5))
            texts.append(" ".join(["x"] * 5 + [f"s{k}" if k in gone else w for k, w in enumerate(item)] + ["y"] * 5).encode())
        assert all(block.search(texts)), n


def test_texts_that_repeat_a_word():
    block = Block([(1, b"ho " * 1000)], 12, 0.8)
    assert block.search([b"ho " * 4000, b"ho " * 9]) == [[(1, 1000, 1000, 0, 0)], []]


def test_passage_beside_weaker_agreement(spark):
    item = [f"v{k}" for k in range(54)]
    copy = item[:12] + [w if k % 7 not in (2, 6) else "zz" for k, w in enumerate(item[12:])]
    docs = documents(spark, [(1, " ".join(["a"] * 30 + copy + ["b"] * 30)), (2, "clean " * 50)])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()] == [(1, 7)]
    assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [2]
