"""The literal examples that describe the operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafcut.functions import hardware as H
from leafcut.functions import quality as Q
from leafcut.functions import text as X
from leafcut.operators import catalog as C
from leafcut.operators import detect as D
from leafcut.operators import models as M
from leafcut.operators import refine as R
from leafcut.operators import segment as S
from leafcut.operators import vectors as V
from leafcut.plans.debundle import debundle
from leafcut.sources import files as SF
from leafcut.streaming import events as E


def pages(spark, texts):
    return spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "bundle_id string, page_num int, text string")


def embedded(spark, vectors):
    return spark.createDataFrame([("b", k, [float(x) for x in v]) for k, v in enumerate(vectors)], "bundle_id string, page_num int, embedding array<float>")


def centres(rng, sizes, noise, d=768):
    out = []
    for n in sizes:
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        for _ in range(n):
            v = c + rng.normal(size=d) * noise
            out.append(v / np.linalg.norm(v))
    return out


def test_number_reset(spark):
    got = D.detect(pages(spark, [f"Page {n}\nbody" for n in (1, 2, 3, 1, 2)]), ("number",)).collect()
    assert [(r.page_num, r.confidence, r.reason) for r in got] == [(3, 0.9, "Page number reset: 3 -> 1")]


def test_blank_page(spark):
    got = D.detect(pages(spark, ["content of the first page " * 3, "more " * 10, "   ", "a long page starts here " * 3]), ("blank",)).collect()
    assert [(r.page_num, r.confidence) for r in got] == [(3, 0.85)]


def test_header_footer(spark):
    got = D.detect(pages(spark, ["Head A\nx\nFoot A", "Head A\ny\nFoot B", "Head B\nz\nFoot C", "one line", None]), ("header_footer",)).collect()
    assert [(r.page_num, r.confidence) for r in got] == [(1, 0.4), (2, 0.6)]


def test_clusters(spark):
    rng = np.random.default_rng(42)
    labels = V.cluster_labels(embedded(spark, centres(rng, (50, 2, 50), 0.01)), eps=0.3)
    assert [r.page_num for r in D.cluster_boundaries(labels).orderBy("page_num").collect()] == [50, 52]


def plain_labels(v, eps, least):
    """Density clusters one page after another."""
    n = len(v)
    near = [[j for j in range(n) if round(float(v[i] @ v[j]), 6) >= 1 - eps] for i in range(n)]
    core = [least <= 1 or (len(near[i]) >= least and v[i].any()) for i in range(n)]
    label, following = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            label[i], todo = following, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = following
                        todo.append(j)
            following += 1
    return [min((label[j] for j in near[i] if core[j]), default=-1) if not core[i] else label[i] for i in range(n)]


def clustered(spark, v, eps, least):
    return [r.label for r in V.cluster_labels(embedded(spark, v), eps, least).orderBy("page_num").collect()]


def test_noise_border_and_zero_vectors(spark):
    v = np.array([[1, 0], [1, 0.01], [0.99, 0], [0, 1], [0, 0]], dtype=float)
    v[:4] /= np.linalg.norm(v[:4], axis=1, keepdims=True)
    v = v.astype("float32").astype(float)
    assert clustered(spark, v, 0.1, 2) == [0, 0, 0, -1, -1]
    assert clustered(spark, v, 0.1, 1) == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("least", [1, 4])
def test_clusters_over_blocks(spark, monkeypatch, block, least):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(3)
    v = np.array(centres(rng, (12, 3, 1, 9, 8), 0.22, d=8))[rng.permutation(33)].astype("float32").astype(float)
    want = plain_labels(v, 0.2, least)
    assert len(set(want)) > 2 and clustered(spark, v, 0.2, least) == want


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_bundles(spark, n):
    df = embedded(spark, centres(np.random.default_rng(1), (n,), 0.1)).withColumn("text", F.lit("x"))
    assert D.combine(D.detect_all(df)).count() <= 1


def test_combine(spark):
    rows = [("b", 3, 0.9, "a", 0), ("b", 3, 0.6, "b", 1), ("b", 3, 0.7, "c", 3), ("b", 3, 0.6, "d", 4), ("b", 5, 0.4, "e", 1), ("b", 6, 0.2, "f", 1)]
    got = D.combine(spark.createDataFrame(rows, "bundle_id string, page_num int, confidence double, reason string, det_ord int")).orderBy("page_num").collect()
    assert [(r.page_num, r.confidence, r.signal_count, r.signals, r.method) for r in got] == [(3, 1.0, 4, ["a", "b", "c", "d"], "heuristic"), (5, 0.4, 1, ["e"], "clustering")]


def test_partial_page_is_invalid(spark):
    header = "A short header over a scanned page, with a few words only."
    rows = spark.createDataFrame([(header, [(50.0, 50.0, 562.0, 120.0)], [(50.0, 150.0, 562.0, 742.0)]), ("This sentence fills the page and it is what we can read of it. " * 50, [(0.0, 0.0, 612.0, 792.0)] * 3, [])], "text string, blocks array<struct<x0:double,y0:double,x1:double,y1:double>>, images array<struct<x0:double,y0:double,x1:double,y1:double>>")
    m = Q.text_metrics(F.col("text"))
    cov = Q.coverage(F.col("blocks"), F.col("images"), F.lit(612.0), F.lit(792.0))
    cov["coverage_confidence"] = Q.coverage_confidence(cov["text_coverage"], cov["uncovered"], F.size("images") > 0, F.size("blocks"))
    conf = Q.adjusted_confidence(Q.confidence(m), cov["coverage_confidence"])
    partial, full = rows.select(Q.page_valid(m, conf, cov).alias("valid"), cov["text_coverage"].alias("cov"), cov["coverage_confidence"].alias("cc"), conf.alias("conf")).collect()
    assert not partial.valid and partial.cov < 0.70 and partial.cc < 0.50
    assert full.valid and full.conf >= 0.80


def test_unknown_page_size_covers_nothing(spark):
    cov = Q.coverage(F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(cov["text_coverage"].alias("t"), cov["uncovered"].alias("u")).first()
    assert (r.t, r.u) == (0.0, 1.0)


def test_empty_text_scores_zero(spark):
    m = Q.text_metrics(F.lit(None).cast("string"))
    r = spark.range(1).select(*(v.alias(k) for k, v in m.items()), Q.confidence(m).alias("conf")).first()
    assert r.conf == 0 and r.total_chars == 0 and r.printable_ratio == 0


def test_decisions(spark):
    texts = ["YES - page numbers reset", "NO - same topic", "YES: new header", "NO: continues", "It is hard to say", "NOT SURE", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_decision(F.col("t")).alias("d")).collect()
    assert [r.d.should_split for r in got] == [True, False, True, False, False, False, False]
    assert got[0].d.reason == "page numbers reset" and got[4].d.reason == "Unclear response: It is hard to say" and got[5].d.reason == "T SURE"


def test_decision_confidence(spark):
    r = spark.range(1).select(X.decision_confidence(F.lit(True), F.lit(2), F.lit("numbers reset")).alias("a"), X.decision_confidence(F.lit(False), F.lit(9), F.lit("unclear")).alias("b")).first()
    assert round(r.a, 6) == 0.85 and round(r.b, 6) == 0.45


def test_file_names(spark):
    texts = ["2024-01-15_Invoice_Acme Supplies Order", '"UNDATED_Letter_To The Board"', "2023-12-01_Report_Annual Sales.pdf", "bad"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_filename(F.col("t")).alias("n")).select("n", X.validate_filename(F.col("n")).alias("ok"), X.fix_filename(F.col("n"), F.lit(4)).alias("f")).collect()
    assert [r.ok for r in got] == [True, True, True, False]
    assert got[1].n == "UNDATED_Letter_To The Board" and got[3].f == "UNDATED_Other_document 5"


def test_batches_and_dpi(spark):
    gb = [1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0]
    got = spark.createDataFrame([(x,) for x in gb], "g double").select(H.batch_size(F.col("g"), True).alias("b"), H.adaptive_dpi(F.col("g"), True, "low").alias("low"), H.adaptive_dpi(F.col("g"), True, "max").alias("most")).collect()
    assert [r.b for r in got] == [8, 8, 15, 25, 35, 50, 60]
    assert all(100 <= r.low <= r.most <= 600 for r in got)


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert H.Settings.load(path).problems() == []
    assert H.Settings(min_confidence=2, cache_ttl_days=0, context=1000, model="x", gpu_layers=41).problems() == ["min_confidence", "cache_ttl_days", "context", "model", "gpu_layers"]
    (tmp_path / "s.json").write_text('{"model": "phi3_mini", "other": 1}')
    assert H.Settings.load(path).model == "phi3_mini"


def test_segments_and_names(spark):
    p = pages(spark, ["Contract between A and B\n1", "x", "Contract between A and B\n1", "y"])
    totals = p.groupBy("bundle_id").agg(F.count("*").cast("int").alias("total"))
    accepted = spark.createDataFrame([("b", 2, 0.9), ("b", 0, 0.9), ("b", 9, 0.9)], "bundle_id string, page_num int, confidence double")
    segs = S.segments(totals, accepted)
    out = S.unique_names(S.named(S.with_page_texts(segs, p))).orderBy("segment_idx").collect()
    assert [(r.start_page, r.end_page, r.page_count) for r in out] == [(0, 1, 2), (2, 3, 2)]
    assert [r.output_filename for r in out] == ["Contract_between_A_and_B_1.pdf", "Contract_between_A_and_B_1_1.pdf"]


def test_debundle_of_nothing(spark):
    assert debundle(pages(spark, [])).count() == 0


def test_refine_keeps_unanswered(spark):
    rows = spark.createDataFrame([("b", 3, 0.6, ["s"], 1, "YES - new"), ("b", 4, 0.6, ["s"], 1, "NO - same"), ("b", 5, 0.6, ["s"], 1, None)], "bundle_id string, page_num int, confidence double, signals array<string>, signal_count int, response string")
    got = {r.page_num: r for r in R.approve(R.decide(rows)).collect()}
    assert set(got) == {3, 5} and got[3].signals == ["s", "LLM: new"] and got[3].signal_count == 2 and got[5].confidence == 0.6


def test_catalog(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    now = F.lit(datetime.datetime(2025, 1, 1))
    made = spark.range(1).select(*C.new_document(F.lit("/in/a.pdf"), F.lit(3), F.lit(10), now))
    cat.append("documents", made)
    doc = cat.table("documents").first()
    assert doc.original_filename == "a.pdf" and doc.processing_status == "ocr_pending"
    cat.append("pages", spark.createDataFrame([(doc.doc_id, 0, "t")], "doc_id string, page_num int, text string"))
    new = spark.createDataFrame([(doc.doc_id, 0, "t", [1.0]), (doc.doc_id, 7, "u", [1.0])], "doc_id string, page_num int, text string, text_embedding array<float>")
    cat.replace("pages", C.update_embeddings(cat.table("pages"), new))
    assert cat.table("pages").first().text_embedding == [1.0] and cat.table("pages").count() == 1
    assert C.Catalog(spark, cat.path).table("_metadata").first().value == "1"
    assert C.expire(cat.table("documents"), datetime.datetime(2025, 3, 1)).count() == 0
    assert C.cascade(cat.table("pages"), C.expire(cat.table("documents"), datetime.datetime(2025, 3, 1))).count() == 0


def test_models(spark):
    texts = ["this contract is made between two parties", "the contract between the two parties is signed", "invoice number 12 total due", "invoice total amount due now"]
    v = spark.createDataFrame([(t,) for t in texts], "t string").select(M.apply_model(F.col("t"), "embed_stub", "array<float>").alias("v")).collect()
    a = np.array([r.v for r in v])
    sim = a @ a.T
    assert a.shape == (4, 64) and np.allclose(np.diag(sim), 1, atol=1e-3) and sim[0, 1] > sim[0, 2]

    def failing():
        def run(xs):
            if "bad" in xs:
                raise ValueError
            return [x.upper() for x in xs]

        return run

    got = spark.createDataFrame([("a",), ("bad",)], "t string").coalesce(1).select(M.apply_model(F.col("t"), failing, "string").alias("x")).collect()
    assert [r.x for r in got] == ["A", ""]


def test_vector_codec(spark):
    df = spark.createDataFrame([([0.5, -2.0],)], "v array<float>").select(SF.decode_vector(SF.encode_vector(F.col("v"))).alias("w"))
    assert df.first().w == [0.5, -2.0]


def test_event_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"type": "progress", "data": "1", "ts": "2025-01-01T00:00:00Z", "key": "k"}\n\n{"type": "info", "data": "x"}\nbroken\n{"type": "progress", "data": "2", "ts": "2025-01-01T00:00:01Z", "key": "k"}\n{"type": "progress", "data": "3", "ts": "2025-01-01T00:01:00Z", "key": "k"}\n')
    q = E.route(E.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("routed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.type for r in spark.table("routed").collect()) == ["error", "progress", "progress", "progress"]
    q = E.throttle(E.event_stream(spark, str(tmp_path / "in")).where("type = 'progress'")).writeStream.outputMode("append").format("memory").queryName("throttled").start()
    q.processAllAvailable()
    (tmp_path / "in/b.json").write_text("".join(f'{{"type": "progress", "data": "{n}", "ts": "2025-01-01T00:01:0{n}Z", "key": "k"}}\n' for n in (1, 2, 3)))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.data for r in spark.table("throttled").collect()) == ["1", "2", "3"]  # 0:00, 1:00, 1:02


def test_throttle(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], datetime.datetime(2025, 1, 1) + datetime.timedelta(milliseconds=int(ms)), bool(rng.random() < 0.05)) for k, ms in enumerate(np.cumsum(rng.integers(0, 1500, 300)))]
    want, last = {r[0] for r in rows if r[3]}, {}
    for k, key, ts, force in rows:
        if not force and (key not in last or ts - last[key] >= datetime.timedelta(seconds=2)):
            want.add(k)
            last[key] = ts
    df = spark.createDataFrame([*rows, (999, "a", None, False)], "id long, key string, ts timestamp, force boolean")
    assert {r.id for r in E.throttle(df, 2.0, order="id", force="force").collect()} == want
    close = spark.createDataFrame([(1, "a", datetime.datetime(2025, 1, 1, 0, 0, 1, 950000)), (2, "a", datetime.datetime(2025, 1, 1, 0, 0, 2, 50000))], "id long, key string, ts timestamp")
    assert [r.id for r in E.throttle(close).collect()] == [1] and E.throttle(close.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ftwo")
    assert [r.text for r in SF.text_pages(spark, str(tmp_path / "d")).orderBy("page_num").collect()] == ["one", "two"]
    assert SF.file_metadata(spark, str(tmp_path / "d")).first().size == 7
    assert SF.zip_files([str(tmp_path / "d/a.txt"), "/nowhere"], str(tmp_path / "z.zip")) == 1
    (tmp_path / "out").mkdir()
    assert SF.copy_files([str(tmp_path / "d/a.txt"), "/nowhere"], str(tmp_path / "out")) == 1 and (tmp_path / "out/a.txt").read_text() == "one\ftwo"
    with pytest.raises(NotADirectoryError):
        SF.copy_files([], "/nowhere")
    (tmp_path / "d/b.png").write_bytes(b"\x89PNG")
    assert [bytes(r.content) for r in SF.images(spark, str(tmp_path / "d")).collect()] == [b"\x89PNG"]


def test_segment_files(spark, tmp_path):
    p = pages(spark, ["a", "b", "c"])
    segs = spark.createDataFrame([("b", 0, 0, 1), ("b", 1, 2, 2)], "bundle_id string, segment_idx int, start_page int, end_page int")
    SF.write_segments(S.page_ranges(segs, p), str(tmp_path / "s"))
    assert sorted((r.segment_idx, r.text) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(0, "a"), (0, "b"), (1, "c")]


def test_vector_codec_of_nulls(spark):
    rows = [([1.5, -2.0],), (None,), ([],), ([0.25],)]
    df = spark.createDataFrame(rows, "v array<float>").coalesce(1).select(SF.encode_vector(F.col("v")).alias("b")).select("b", SF.decode_vector(F.col("b")).alias("w"))
    got = df.collect()
    assert [r.w for r in got] == [r[0] for r in rows] and bytes(got[0].b) == np.array([1.5, -2.0], "<f4").tobytes() and got[1].b is None


def test_unique_names(spark):
    rng = np.random.default_rng(7)
    names = [["a", "a_1", "a_1_1", "a_2", "b", "document_0001", "_1", ""][k] for k in rng.integers(0, 8, 120)]
    rows = [("ab"[k % 2], k, n) for k, n in enumerate(names)] + [("c", k, n) for k, n in enumerate(["a", "a", "a_1"])]
    there = [("a", "a.pdf"), ("a", "b_1.pdf"), ("d", "a.pdf")]
    df = spark.createDataFrame(rows, "bundle_id string, segment_idx int, suggested_name string")
    for existing in (None, there):
        files = existing and spark.createDataFrame(existing, "bundle_id string, output_filename string")
        taken, want = {f for f in existing or ()}, {}
        for b, k, n in rows:
            own, i = f"{n}.pdf", 0
            while (b, own) in taken:
                i += 1
                own = f"{n}_{i}.pdf"
            taken.add((b, own))
            want[b, k] = own
        got = {(r.bundle_id, r.segment_idx): r.output_filename for r in S.unique_names(df, existing=files).collect()}
        assert got == want
    assert want["c", 2] == "a_1_1.pdf"


def test_upsert_keeps_the_table_whole(spark):
    schema = "doc_id string, page_num int, text string, text_length int, has_text_layer boolean, ocr_method string, ocr_confidence double, text_embedding array<float>, features string, processed_at timestamp"
    day = [datetime.datetime(2025, 1, k) for k in (1, 2, 3)]
    old = spark.createDataFrame([("d", 0, "t", 1, True, "text_layer", 0.9, [1.0], "f", day[0]), ("d", 1, "u", 1, False, "ocr", 0.1, [2.0], "g", day[0]), ("d", 2, "v", 1, False, "ocr", 0.2, [3.0], "h", day[0])], schema)
    new = spark.createDataFrame([("d", 1, "x", "m", day[2]), ("d", 1, "u", "n", day[1]), ("d", 2, "v", "o", day[1]), ("e", 0, None, "p", day[1])], "doc_id string, page_num int, text string, ocr_method string, processed_at timestamp")
    out = C.upsert_pages(old, new)
    assert out.columns == old.columns
    got = {(r.doc_id, r.page_num): tuple(r)[2:] for r in out.collect()}
    assert got == {
        ("d", 0): ("t", 1, True, "text_layer", 0.9, [1.0], "f", day[0]),
        ("d", 1): ("x", 1, None, "m", None, None, None, day[2]),
        ("d", 2): ("v", 1, None, "o", None, [3.0], None, day[1]),
        ("e", 0): (None, None, None, "p", None, None, None, day[1]),
    }


def test_catalog_rows(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    cat.append("processing_log", spark.createDataFrame([(1, "d", "ocr", "completed")], "log_id bigint, doc_id string, phase string, status string"))
    cat.append("split_results", spark.createDataFrame([(1, "d", "a.pdf", 0, 3)], "result_id bigint, doc_id string, output_filename string, start_page int, end_page int"))
    assert cat.table("processing_log").first().phase == "ocr" and C.of_document(cat.table("split_results"), "d").first().end_page == 3
    cat.append("document_names", spark.createDataFrame([(k, "d", 9 - k, "n") for k in range(3)], "name_id bigint, doc_id string, start_page int, suggested_name string"))
    assert [r.start_page for r in C.of_document(cat.table("document_names"), "d", "start_page").collect()] == [7, 8, 9]
    assert C.page_of(cat.table("pages"), "d", 0).count() == 0
    none, n = C.clear(cat.table("document_names"))
    cat.replace("document_names", none)
    assert n == 3 and cat.table("document_names").count() == 0
    queue = C.append_queue(spark.createDataFrame([("1", "/x/a.pdf", "complete", 100)], "id string, file_path string, status string, progress int"), spark.createDataFrame([("/x/b.pdf",)], "file_path string"))
    assert sorted((r.file_path, r.status, r.progress, r.id is not None) for r in queue.collect()) == [("/x/a.pdf", "complete", 100, True), ("/x/b.pdf", "pending", 0, True)]


def test_settings_change(tmp_path):
    path = str(tmp_path / "s.json")
    H.Settings.load(path).updated(path, model="phi3_mini", unknown=1)
    assert H.Settings.load(path).model == "phi3_mini"
    H.Settings.reset(path)
    assert H.Settings.load(path) == H.Settings()


def test_model_in_batches(spark):
    seen = []

    def model():
        def run(items):
            seen.append(len(items))
            if len(items) > 6:
                raise MemoryError
            return [x * 2 for x in items]

        return run

    assert M.in_batches(model, 16)()(list(range(40))) == [2 * k for k in range(40)] and max(seen) == 16 and min(seen) >= 1
    with pytest.raises(MemoryError):
        M.in_batches(lambda: lambda items: (_ for _ in ()).throw(MemoryError), 4)()([1])

    def broken():
        raise OSError("no model here")

    got = spark.createDataFrame([("a b",)], "t string").select(M.apply_model(F.col("t"), broken, "array<float>", fallback="embed_stub").alias("v")).first()
    assert len(got.v) == 64


def test_own_detector_and_thresholds(spark):
    own = lambda p: p.where("page_num = 1").select("bundle_id", "page_num", F.lit(0.9).alias("confidence"), F.lit("own").alias("reason"), F.lit(9).alias("det_ord"))
    df = embedded(spark, [[1.0, 0.0]] * 3).withColumn("text", F.lit("x"))
    assert "own" in D.combine(D.detect_all(df, extra=(own,))).first().signals
    m = Q.with_metrics(spark.createDataFrame([("It is what we have here and that is all of it.",)], "text string"))
    strict, loose = m.select(Q.page_valid(Q.measured(), F.lit(0.9)).alias("a"), Q.page_valid(Q.measured(), F.lit(0.9), t=Q.Thresholds(min_chars=10, min_density=0)).alias("b")).first()
    assert not strict and loose


def test_metrics_once_or_twice(spark):
    texts = [" The Cat\u00e9 sat_on the  mat. \u00a0", "\u200bx\x00", "", None, "A1 b2! c\u0301d"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for strip in (True, False):
        a = rows.select(*(v.alias(k) for k, v in Q.text_metrics(F.col("text"), strip=strip).items())).collect()
        assert a == Q.with_metrics(rows, strip=strip).select(*Q.METRICS).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_text("no document")

    plain = SF.form_feed_reader()

    def strict():
        def read(raw):
            if raw == b"bad":
                raise ValueError("no PDF")
            return plain(raw)

        return read

    got = SF.document_pages(spark, str(tmp_path), strict)
    assert sorted((r.bundle_id[-5:], r.page_num, r.text, r.problem) for r in got.collect()) == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None), ("b.pdf", None, None, "ValueError: no PDF")]
    assert {r.bundle_id[-5:]: r.total_pages for r in SF.page_counts(got).collect()} == {"a.pdf": 2, "b.pdf": 0}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SF.document_pages(spark, str(tmp_path / "nowhere")).count()


def test_streams_stop_and_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"type": "progress", "data": "1"}\n')
    seen = []
    listener = E.Progress(lambda rows, own, name: seen.append((rows, own, name)))
    spark.streams.addListener(listener)
    start = lambda name: E.event_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(name).start()
    q = start("told")
    q.processAllAvailable()
    assert E.stop_after(q, 0.3) == "timeout" and not q.isActive
    assert E.stop_after(start("dropped"), 30, cancelled=lambda: True) == "cancelled"
    q = E.event_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("whole").trigger(availableNow=True).start()
    assert E.stop_after(q, 30) == "ended"
    spark.streams.removeListener(listener)
    assert (1, 1, "told") in seen


def test_white_space_is_pythons(spark):
    space = "".join(chr(k) for k in range(0x110000) if chr(k).isspace())
    assert space == X.WS_CHARS
    rows = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in [*space, "​", "﻿", "\x00"]], "t string")
    got = rows.select("t", X.py_strip(F.col("t")).alias("s"), F.regexp_count("t", F.lit(X.WS)).alias("n"), X.clean_text(F.col("t")).alias("c")).collect()
    assert all((r.s, r.n, r.c) == (r.t.strip(), sum(c.isspace() for c in r.t), " ".join(r.t.split())) for r in got)


def test_report_rounds_what_is_stored(spark):
    rows = [(24, 2, 1.0, 0.625, 0.865), (40, 6, 0.999, 0.825, 0.575172), (8, 1, 0.375, 0.995, 0.65), (0, 0, 0.0, 0.0, 0.0)]
    m = spark.createDataFrame(rows, "total_chars int, word_count int, printable_ratio double, alphanumeric_ratio double, conf double")
    got = [r.report for r in m.select(Q.quality_report(Q.measured(), F.col("conf")).alias("report")).collect()]
    assert got == [f"chars {n}, words {w}, printable {p:.2f}, alphanumeric {a:.2f}, confidence {c:.2f}: {'VALID' if c >= 0.65 else 'INVALID'}" for n, w, p, a, c in rows]


def test_similarity_matrix_in_blocks(spark):
    """Blocks are multiplied as a whole, not pair by pair in a join; pages of several blocks, of no length or with a null."""
    rng = np.random.default_rng(5)
    v = {k: rng.normal(size=8).astype("float32").tolist() for k in (0, 1, 1023, 1024, 1025, 2048, 5000)}
    v |= {2049: [0.0] * 8, 2050: [1.0] * 7 + [None], 2051: [1.0] * 3, 2052: None}
    rows = [("b", k, x) for k, x in v.items()] + [("c", 0, v[0]), (None, 0, v[0])]
    df = V.similarity_matrix(spark.createDataFrame(rows, "bundle_id string, page_num int, embedding array<float>"))
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.bundle_id, r.i, r.j): r.similarity for r in df.collect()}

    def one(x, y):
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            return None
        a, b = (np.array(z, float) / (np.sqrt(np.dot(np.array(z, float), z)) + 1e-8) for z in (x, y))
        return round(float(a @ b), 6) + 0.0

    want = {("b", i, j): one(x, y) for i, x in v.items() for j, y in v.items()} | {("c", 0, 0): 1.0}
    assert got.keys() == want.keys() and len(got) == 122
    assert all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-9) for k, w in want.items())


def test_names_of_one_page_keep_their_order(spark, tmp_path):
    """Orders 100003 apart start at the same page; whatever order they are read in, the lesser comes first."""
    rows = [(k + j * 100003, 1, f"{j}-{k}") for k in range(40) for j in (2, 0, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    from leafcut.plans.queries import QUERIES

    got = sorted(QUERIES["q69_name_scan"](spark, str(tmp_path)).collect(), key=lambda r: r.nth)
    assert [r.suggested_name for r in got] == [f"{j}-{k}" for k in sorted(range(40), key=lambda k: k * 7 % 100003) for j in range(3)]


def test_throttle_in_cells(spark):
    """Dense, sparse, repeated and far times of several keys, one of them null, over many cells and batches."""
    rng = np.random.default_rng(7)
    ms = {"dense": np.arange(30000) * 977, "close": rng.integers(0, 5000, 3000), "long": np.cumsum(rng.integers(0, 3900, 3000)), None: rng.integers(-(10**8), 10**8, 3000), "edge": np.array([0, E.CELL - 1, E.CELL, E.CELL + 1998, E.CELL + 1999, 9 * E.CELL])}
    rows = [(key, int(x)) for key, xs in ms.items() for x in xs]
    rows = [(k, key, x) for k, (key, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, key string, ms long").select("id", "key", F.timestamp_millis("ms").alias("ts"))
    thrown = E.throttle(df, 2.0, order="id")
    plan = thrown._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan  # neither a key in one task nor a call for each few events
    want, last = set(), {}
    for k, key, x in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        if key not in last or x - last[key] >= 2000:
            want.add(k)
            last[key] = x
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {r.id for r in thrown.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert E.throttle(df, 0.0).count() == len(rows)


def test_few_pages_meet_all_others(spark, monkeypatch):
    """Blocks are joined by themselves; of pages with one part in all, none is sent to other blocks."""
    sent = []
    monkeypatch.setattr(V, "_blocks", lambda *x: sent.append(x))
    rng = np.random.default_rng(9)
    v = np.array(centres(rng, (9000,), 0.3, d=8) + centres(rng, (3, 2), 0.05, d=8) + [np.zeros(8)])[rng.permutation(9006)].astype("float32").astype(float)
    near = np.round(v @ v.T, 6) >= 0.9
    want, todo = np.full(9006, -1), []
    for k in range(9006):
        if want[k] < 0:
            want[k], todo = want.max() + 1, [k]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (want < 0))
                want[new] = want[k]
                todo += new.tolist()
    assert clustered(spark, v, 0.1, 1) == want.tolist() and not sent


def test_debundle_shuffles_no_text(spark, sf):
    from leafcut.plans.queries import QUERIES

    plan = QUERIES["q59_debundle_full"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange hashpartitioning(bundle_id")[1:]:
        line = part.splitlines()[1]
        assert " AS text#" not in line and ", text#" not in line, line


def test_models_get_few_items_at_once(spark):
    df = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("t"))

    def counting():
        return lambda xs: [f"{x} {len(xs)}" for x in xs]

    got = [r.x.split() for r in df.select(M.apply_model(F.col("t"), counting, "string").alias("x")).collect()]
    assert [int(t) for t, _ in got] == list(range(1000)) and max(int(n) for _, n in got) <= M.ITEMS


def test_page_number_searches_each_pattern_once(spark):
    texts = ["Page 0", "Page 00012", "Page 12345 p. 7", "Page 99999999999999999999999999999999999999999\n8", "Page 10000", "Page 9999", "p. 0000\n- 0003 -", "x", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.page_number(F.col("t")).alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 4
    assert [r.n for r in sorted(df.collect())] == [None, 12, 7, 8, None, 9999, 3, None, None]
