"""The registered queries of the page-analysis operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from leafcut.plans import views as B
from leafcut.plans.debundle import debundle
from leafcut.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(x):
    return F.round(x, 6)


@query
def q01_page_number_extract(s, d):
    return B.numbered_bundle(s, d).select("bundle_id", "page_num", X.page_number(c("text")).alias("num"))


@query
def q02_page_number_reset(s, d):
    return D.detect(B.numbered_bundle(s, d), ("number",))


@query
def q03_header_footer_change(s, d):
    return D.detect(B.measured_bundle(s, d, ("header_footer",)), ("header_footer",))


@query
def q04_blank_separator(s, d):
    pages = B.measured_bundle(s, d, ("blank",)).select("bundle_id", "page_num", "stripped")
    return D.detect(pages.unionByName(D.narrow(B.chat_bundle(s, d), ("blank",))), ("blank",))


@query
def q05_semantic_discontinuity(s, d):
    return D.detect(B.vector_bundle(s, d), ("semantic",))


@query
def q06_similarity_matrix(s, d):
    return V.similarity_matrix(B.vector_bundle(s, d))


@query
def q07_cluster_labels(s, d):
    return V.cluster_labels(B.vector_bundle(s, d), eps=0.75)


@query
def q08_cluster_boundary(s, d):
    return D.cluster_boundaries(V.cluster_labels(B.vector_bundle(s, d), eps=0.75))


def _candidates(s, d):
    text = D.detect(B.measured_bundle(s, d, ("header_footer", "blank")), ("header_footer", "blank"))
    return D.combine(text.unionByName(D.detect(B.vector_bundle(s, d), ("semantic",), low=0.0, mid=0.1)))


@query
def q09_combine_signals(s, d):
    return _candidates(s, d).withColumn("signals", F.array_join("signals", "|"))


def _segments(s, d):
    totals = B.page_order(s, d).groupBy("bundle_id").agg(F.count("*").cast("int").alias("total"))
    return S.segments(totals, S.accept(D.combine(D.detect(B.measured_bundle(s, d)))))


@query
def q10_segments(s, d):
    return _segments(s, d)


@query
def q11_segment_report(s, d):
    segs = S.with_page_texts(_segments(s, d), B.text_bundle(s, d))
    return segs.select("bundle_id", "segment_idx", "start_page", "end_page", "page_count", F.length("first_text").alias("first_chars"), F.length("second_text").alias("second_chars"))


@query
def q12_heuristic_names(s, d):
    segs = S.named(S.with_page_texts(_segments(s, d), B.text_bundle(s, d)))
    return segs.select("bundle_id", "segment_idx", "suggested_name")


@query
def q13_unique_names(s, d):
    k = c("page_num") % 4
    name = F.when(k < 2, "a").when(k == 2, "a_1").otherwise(X.make_safe_filename(c("text")))
    return S.unique_names(B.text_bundle(s, d).select("bundle_id", c("page_num").alias("segment_idx"), name.alias("suggested_name")))


def _metrics(s, d):
    return Q.with_metrics(B.table(s, d, "documents").select("doc_id", "text")).select("doc_id", *Q.METRICS)


_m = Q.measured


@query
def q14_text_metrics(s, d):
    out = _metrics(s, d)
    return out.select("doc_id", *(r6(c(k)).alias(k) if "ratio" in k or k in ("avg_word_length", "text_density") else c(k) for k in Q.METRICS))


@query
def q15_text_confidence(s, d):
    return _metrics(s, d).select("doc_id", Q.confidence(_m()).alias("confidence"))


@query
def q16_page_validity(s, d):
    m = _metrics(s, d).withColumn("confidence", Q.confidence(_m()))
    return m.select("doc_id", Q.page_valid(_m(), c("confidence")).alias("valid"))


@query
def q17_invalid_reason(s, d):
    m = _metrics(s, d).withColumn("valid", Q.page_valid(_m(), Q.confidence(_m())))
    return m.select("doc_id", Q.needs_ocr_reason(_m(), c("valid")).alias("reason"))


@query
def q18_structure_sample(s, d):
    pages = B.page_order(s, d)
    n = pages.groupBy("bundle_id").agg(F.count("*").alias("n")).withColumn("k", F.least(F.lit(10), c("n")))
    picks = n.select("bundle_id", "n", "k", F.explode(F.sequence(F.lit(0), (c("k") - 1).cast("int"))).alias("i")).select("bundle_id", "n", "k", F.floor(c("i") * c("n") / c("k")).cast("int").alias("page_num"))
    # Only sampled pages are measured.
    sampled = picks.join(pages, ["bundle_id", "page_num"]).join(B.table(s, d, "documents").select("doc_id", "text"), "doc_id")
    m = Q.with_metrics(sampled.select("bundle_id", "n", "k", "text")).withColumn("conf", Q.confidence(_m()))
    m = m.withColumn("valid", Q.page_valid(_m(), c("conf")))
    out = m.groupBy("bundle_id", "n", "k").agg(F.count_if("valid").alias("valid_samples"), r6(F.sum("conf") / F.max("k")).alias("avg_confidence"))
    needs = c("valid_samples") < c("k") / 2
    return out.select("bundle_id", c("n").alias("total_pages"), c("k").cast("bigint").alias("sample_size"), "valid_samples", "avg_confidence", needs.alias("needs_ocr"), (c("valid_samples") > 0).alias("has_valid"), F.when(needs, c("n")).otherwise(0).cast("bigint").alias("ocr_pages_estimated"))


def _coverage(s, d):
    g = B.geometry(s, d)
    cov = Q.coverage(c("blocks"), c("images"), c("page_w"), c("page_h"))
    return g.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.size("images") > 0).alias("has_images"), F.size("blocks").alias("n_blocks"), *(v.alias(k) for k, v in cov.items()))


@query
def q19_coverage(s, d):
    return _coverage(s, d).drop("n_blocks")


@query
def q20_coverage_confidence(s, d):
    out = _coverage(s, d).withColumn("coverage_confidence", Q.coverage_confidence(c("text_coverage"), c("uncovered"), c("has_images"), c("n_blocks")))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "coverage_confidence", Q.adjusted_confidence(F.lit(0.75), c("coverage_confidence")).alias("adjusted"))


@query
def q21_ocr_output_validity(s, d):
    reason = X.page_invalid_reason(c("text"))
    return B.table(s, d, "conversations").select("conv_id", "turn", reason.isNull().alias("valid"), reason.alias("reason"))


@query
def q22_replace_decision(s, d):
    base = B.table(s, d, "documents").select("doc_id", c("text").alias("original"), F.regexp_replace("text", "[aeiou]", "").alias("ocr"))
    first = Q.with_metrics(base, "original", strip=False).withColumn("original_confidence", Q.confidence(_m())).drop(*Q.METRICS)
    out = Q.with_metrics(first, "ocr", strip=False).withColumn("ocr_confidence", Q.confidence(_m()))
    return out.select("doc_id", "original_confidence", "ocr_confidence", Q.replace_with_ocr(c("original"), c("original_confidence"), c("ocr_confidence")).alias("replace"))


@query
def q23_ocr_retry_ladder(s, d):
    e = B.table(s, d, "events").withColumn("k", c("event_id") % 6)
    a = F.when(c("k") == 0, "good text").when(c("k") == 1, "###").otherwise("")
    b = F.when(c("k") == 1, F.concat(F.lit("second "), "event_type")).when(c("k") == 2, "!!! ??? a").otherwise("...")
    t = F.when(c("k") <= 3, F.concat(F.lit("third "), "event_type")).otherwise("   ")
    got = Q.retry_ladder(("primary_400", a), ("second_300", b), ("second_400", t))
    return e.select("event_id", got.alias("g")).select("event_id", "g.text", "g.engine")


@query
def q24_line_aggregate(s, d):
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(X.py_strip(x)) > 0)
    scores = F.transform(lines, lambda x: (F.length(x) % 100) / F.lit(100.0))
    rows = B.table(s, d, "documents").select("doc_id", lines.alias("lines"), scores.alias("scores"))
    mean = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")).otherwise(0.0)
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.length(F.array_join("lines", "\n")).alias("n_chars"), r6(mean).alias("confidence"))


@query
def q25_word_aggregate(s, d):
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.struct(w.alias("w"), (F.length(w) * 17 % 101).alias("conf")))
    kept = F.filter(words, lambda x: (x["conf"] > 60) & X.word_valid(x["w"]))
    rows = B.table(s, d, "documents").select("doc_id", kept.alias("k"))
    mean = F.when(F.size("k") > 0, F.aggregate("k", F.lit(0.0), lambda a, x: a + x["conf"]) / F.size("k") / 100).otherwise(0.0)
    return rows.select("doc_id", F.size("k").alias("n_words"), F.length(F.array_join(F.transform("k", lambda x: x["w"]), " ")).alias("n_chars"), r6(mean).alias("confidence"))


def _context(s, d):
    return R.context_pages(_candidates(s, d), B.text_bundle(s, d))


@query
def q26_context_pages(s, d):
    return _context(s, d).select("bundle_id", "page_num", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query
def q27_split_prompt(s, d):
    return _context(s, d).select("bundle_id", "page_num", F.md5(X.split_prompt(c("before"), c("after"), c("signals"), c("page_num"))).alias("prompt"))


@query
def q28_naming_prompt(s, d):
    segs = S.with_page_texts(_segments(s, d), B.text_bundle(s, d))
    return segs.select("bundle_id", "segment_idx", F.md5(X.naming_prompt(c("first_text"), c("second_text"))).alias("prompt"))


def _responses(s, d):
    """Answers built of conversation turns; every fifth says nothing clear."""
    k = (c("conv_id") + c("turn")) % 5
    start = F.when(k == 0, "YES - ").when(k == 1, "no: ").when(k == 2, "  Yes: clear boundary, ").when(k == 3, "NO - maybe unclear ").otherwise("Perhaps ")
    rows = B.table(s, d, "conversations")
    return rows.select("conv_id", "turn", F.concat(start, F.coalesce("text", F.lit(""))).alias("response"), (c("turn") % 4 + 1).cast("int").alias("signal_count"))


@query
def q29_parse_decision(s, d):
    return _responses(s, d).select("conv_id", "turn", X.parse_decision(c("response")).alias("p")).select("conv_id", "turn", "p.should_split", "p.reason")


@query
def q30_llm_confidence(s, d):
    return R.decide(_responses(s, d)).select("conv_id", "turn", "llm_confidence")


@query
def q31_llm_filter(s, d):
    rows = R.decide(_responses(s, d)).withColumn("confidence", F.lit(0.5)).withColumn("signals", F.array(F.lit("x")))
    return R.approve(rows).select("conv_id", "turn", r6(c("confidence")).alias("confidence"), "signal_count", F.array_join("signals", "|").alias("signals"))


def _names(s, d):
    k = c("conv_id") % 5
    head = F.when(k == 0, "2024-01-31_Invoice_").when(k == 1, "UNDATED_Letter_").when(k == 2, "  \"2023-1-5_Bad type_").when(k == 3, "2020-12-01_Report").otherwise("UNDATED_Form_x_")
    rows = B.table(s, d, "conversations").where("text is not null")
    body = F.regexp_replace("text", "[^a-zA-Z ]", "")
    return rows.select("conv_id", "turn", F.concat(head, body, F.when(c("turn") % 2 == 0, ".PDF").otherwise("\"")).alias("response"))


def _parsed(s, d):
    return _names(s, d).select("conv_id", "turn", X.parse_filename(c("response")).alias("name"))


@query
def q32_parse_filename(s, d):
    return _parsed(s, d)


@query
def q33_validate_filename(s, d):
    return _parsed(s, d).select("conv_id", "turn", X.validate_filename(c("name")).alias("valid"))


@query
def q34_fix_filename(s, d):
    return _parsed(s, d).select("conv_id", "turn", X.fix_filename(c("name"), c("turn").cast("int")).alias("fixed"))


@query
def q35_name_metadata(s, d):
    return _parsed(s, d).select("conv_id", "turn", X.name_metadata(c("name")).alias("m")).select("conv_id", "turn", "m.*")


@query
def q36_latest_by_path(s, d):
    return C.latest_by(B.files(s, d), ["file_path"], [c("uploaded_at").desc(), c("n").desc()]).select("file_path", "doc_id", "uploaded_at")


@query
def q37_last_phase(s, d):
    return C.last_phase(B.log(s, d))


def _stored_pages(s, d):
    docs = B.table(s, d, "documents").select(c("source").alias("doc_id"), c("doc_id").alias("n"), "text")
    rows = docs.join(B.table(s, d, "embeddings").select(c("vec_id").alias("n"), c("embedding").alias("text_embedding")), "n", "left")
    return rows.withColumn("page_num", c("n").cast("int"))


@query
def q38_cache_stats(s, d):
    return C.cache_stats(B.files(s, d), _stored_pages(s, d))


@query
def q39_completeness(s, d):
    pages = _stored_pages(s, d)
    documents = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    return C.completeness(pages, documents).join(C.completeness(pages, documents, 0.5).select("doc_id", c("enough").alias("half")), "doc_id")


def _full_pages(s, d):
    day = F.lit("2025-01-01").cast("timestamp")
    return _stored_pages(s, d).select(
        "doc_id", "page_num", "text", F.length("text").alias("text_length"), (c("n") % 3 == 0).alias("has_text_layer"), F.when(c("n") % 3 == 0, "text_layer").otherwise("ocr").alias("ocr_method"),
        (c("n") % 100 / F.lit(100.0)).alias("ocr_confidence"), "text_embedding", F.concat(F.lit("f"), c("n").cast("string")).alias("features"), day.alias("processed_at"), "n",
    )


@query
def q40_upsert_pages(s, d):
    pages = _full_pages(s, d)
    page = F.when(c("n") % 10 == 0, c("page_num") + 1000000).otherwise(c("page_num"))
    text = F.when(c("n") % 4 == 0, F.concat(F.lit("new "), "text")).otherwise(c("text"))

    def written(rows, text, method, day):
        return rows.select("doc_id", page.alias("page_num"), text.alias("text"), F.lit(True).alias("has_text_layer"), F.lit(method).alias("ocr_method"), F.lit(0.5).alias("ocr_confidence"), F.lit(day).cast("timestamp").alias("processed_at"))

    # Every third of the pages written is written twice.
    new = written(pages.where("n % 6 = 0"), F.concat(F.lit("again "), "text"), "again", "2025-01-03").union(written(pages.where("n % 2 = 0"), text, "new", "2025-01-02"))
    out = C.upsert_pages(pages.drop("n"), new)
    return out.select("doc_id", "page_num", "text_length", F.md5("text").alias("sum"), "has_text_layer", "ocr_method", "ocr_confidence", c("text_embedding").isNotNull().alias("embedded"), "features", F.date_format("processed_at", "yyyy-MM-dd").alias("day"))


@query
def q41_update_embeddings(s, d):
    pages = _stored_pages(s, d)
    vectors = pages.where("n % 3 = 0").select("doc_id", "page_num", F.array(F.lit(1.0).cast("float")).alias("text_embedding"))
    return C.update_embeddings(pages, vectors).select("doc_id", "page_num", F.coalesce(F.size("text_embedding"), F.lit(-1)).alias("dimension"))


@query
def q42_expire(s, d):
    return C.expire(B.files(s, d), F.lit("1997-01-01").cast("timestamp"), 365).select("doc_id", "uploaded_at")


@query
def q43_delete_cascade(s, d):
    kept = C.without(B.files(s, d), B.files(s, d).where("n % 7 = 0"))
    child = B.table(s, d, "lineitem").select(c("l_orderkey").cast("string").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return C.cascade(child, kept).groupBy("doc_id").agg(F.count("*").alias("n_children"))


@query
def q44_candidate_scan(s, d):
    now = F.lit("2025-01-01").cast("timestamp")
    rows = C.candidate_rows(_candidates(s, d), now)
    rows = rows.withColumn("status", F.when(c("split_page") % 2 == 0, "accepted").otherwise(c("status")))
    return C.candidate_scan(rows, "pending").select("doc_id", "split_page", "confidence", "detection_method", F.array_join("reasoning.signals", "|").alias("signals"), c("reasoning.signal_count").alias("signal_count"))


def _queue(s, d):
    status = F.when(c("n") % 5 == 0, "failed").when(c("n") % 5 == 1, "processing").when(c("n") % 5 == 2, "pending").otherwise("complete")
    return B.files(s, d).select(c("n").alias("id"), "file_path", c("total_pages").alias("pages"), "size", status.alias("status"))


@query
def q45_status_counts(s, d):
    return C.status_counts(_queue(s, d))


@query
def q46_queue_sort(s, d):
    return C.queue_order(_queue(s, d), "status", ascending=False).select("id", "status")


@query
def q47_batch_stats(s, d):
    return C.batch_stats(_queue(s, d).withColumn("seconds", c("pages") * F.lit(0.25)))


@query
def q48_method_counts(s, d):
    m = _metrics(s, d)
    method = F.when(Q.page_valid(_m(), Q.confidence(_m())), "text_layer").otherwise("ocr")
    return m.groupBy(method.alias("method")).agg(F.count("*").alias("pages"))


@query
def q49_batches(s, d):
    return C.batches(B.page_order(s, d), 10).select("bundle_id", "page_num", "batch")


@query
def q50_step_functions(s, d):
    gb = c("p_size").cast("double") / 4
    used = c("p_size") / F.lit(50.0)
    p = B.table(s, d, "part")
    return p.select(
        "p_partkey", H.batch_size(gb, True).alias("gpu_batch"), H.batch_size(gb * 3, False).alias("cpu_batch"), H.adaptive_dpi(gb, True, "high").alias("gpu_dpi"), H.adaptive_dpi(gb * 3, False, "max").alias("cpu_dpi"),
        H.memory_pressure(used).alias("pressure"), H.adjusted_batch(c("p_size"), H.memory_pressure(used)).alias("batch"), H.model_tier(gb).alias("tier"), r6(H.decode_seconds(c("p_size"), "hybrid")).alias("seconds"),
    )


@query
def q51_progress_eta(s, d):
    e = B.table(s, d, "events")
    return e.select("event_id", *C.progress(c("event_id") % 50, F.lit(40) * (c("event_id") % 3), c("value")))


@query
def q52_size_format(s, d):
    return B.table(s, d, "orders").select("o_orderkey", X.size_format(c("o_totalprice").cast("bigint")).alias("size"), X.size_format(c("o_orderkey") * 1048576).alias("big"))


def _events(s, d):
    kind = F.when(c("event_id") % 4 == 0, "progress").when(c("event_id") % 4 == 1, "result").when(c("event_id") % 4 == 2, "info").otherwise("error")
    return B.table(s, d, "events").select("event_id", kind.alias("type"), c("props").alias("data"), "ts", c("user_id").cast("string").alias("key"))


@query
def q53_event_routing(s, d):
    return E.route(_events(s, d)).groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query
def q54_progress_throttle(s, d):
    clock = F.timestamp_millis(c("event_id") * 150 + c("event_id") % 7 * 130)
    rows = B.table(s, d, "events").where("event_id % 4 = 0").select("event_id", clock.alias("ts"), F.floor(c("event_id") / 4 % 2).cast("string").alias("key"), (c("event_id") % 40 == 0).alias("force"))
    return E.throttle(rows, 2.0, order="event_id", force="force").select("key", "event_id")


@query
def q55_embed_stub(s, d):
    v = M.apply_model(c("text"), "embed_stub", "array<float>")
    return B.table(s, d, "documents").select("doc_id", v.alias("v")).select("doc_id", F.size("v").alias("dimension"), F.round(V.dot(c("v"), c("v")), 3).alias("norm"))


@query
def q56_ocr_stub(s, d):
    return B.table(s, d, "pages").select("page_id", F.length(M.apply_model(c("html").cast("binary"), "ocr_stub", "string")).alias("chars"))


@query
def q57_llm_stub(s, d):
    prompt = X.split_prompt(c("before"), c("after"), c("signals"), c("page_num"))
    return R.decide(_context(s, d).withColumn("response", M.apply_model(prompt, "llm_stub", "string"))).select("bundle_id", "page_num", "llm_decision", "llm_confidence")


@query
def q58_effective_text(s, d):
    pages = B.text_bundle(s, d)
    ocr = pages.where("page_num % 2 = 0").select("bundle_id", "page_num", F.concat(F.lit("OCR "), "text").alias("text"))
    out = M.effective_text(Q.with_metrics(pages), ocr, Q.page_valid(_m(), Q.confidence(_m())))
    return out.select("bundle_id", "page_num", F.length("text").alias("chars"), F.md5("text").alias("sum"), "ocr_method")


@query
def q59_debundle_full(s, d):
    from leafcut.plans.debundle import Parameters

    return debundle(B.measured_bundle(s, d, names=True), B.vector_bundle(s, d), Parameters(eps=0.75, low=0.0, mid=0.1))


@query
def q60_pages_to_segments(s, d):
    return S.page_ranges(_segments(s, d), B.page_order(s, d)).select("bundle_id", "page_num", "segment_idx")


@query
def q61_segment_summary(s, d):
    return S.summary(_segments(s, d))


@query
def q62_approved_pages(s, d):
    rows = R.decide(_responses(s, d)).select(c("conv_id").cast("string").alias("bundle_id"), c("turn").cast("int").alias("page_num"), "llm_decision", "llm_confidence")
    return R.approved_pages(rows).select("bundle_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query
def q63_queue_state(s, d):
    return C.queue_state(_queue(s, d))


@query
def q64_update_queue(s, d):
    rows = _queue(s, d).withColumn("progress", F.lit(10)).withColumn("error", F.lit("old"))
    changes = rows.where("id % 3 = 0").select("id", F.lit("complete").alias("status"), F.when(c("id") % 2 == 0, 100).alias("progress"), F.lit(None).cast("string").alias("error"))
    return C.update_queue(rows, changes).select("id", "status", "progress", "error")


@query
def q65_model_usage(s, d):
    rows = _responses(s, d).withColumn("failed", c("turn") % 6 == 5)
    return rows.agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.count_if(~c("failed")).alias("ok"), F.sum(F.when(~c("failed"), F.size(X.words_of(c("response"))))).alias("tokens"))


@query
def q66_resume(s, d):
    last = C.last_phase(B.log(s, d).withColumn("phase", F.get(F.array(*map(F.lit, C.PHASES)), (c("log_id") % 5).cast("int"))))
    return last.select("doc_id", "last_phase", C.phase_done(c("last_phase"), "ocr").alias("skip_ocr"), C.phase_done(c("last_phase"), "split_detection").alias("skip_splits"))


@query
def q67_point_lookup(s, d):
    return C.of_document(B.files(s, d), "7").select("doc_id", "file_path", "total_pages", "size")


@query
def q68_page_lookup(s, d):
    pages = B.table(s, d, "documents").join(B.table(s, d, "embeddings").select(c("vec_id").alias("doc_id"), c("embedding").alias("text_embedding")), "doc_id", "left")
    pages = pages.select(c("source").alias("doc_id"), c("doc_id").cast("int").alias("page_num"), "text", "text_embedding")
    first = B.table(s, d, "documents").agg(F.min_by("source", "doc_id").alias("s"), F.min("doc_id").cast("int").alias("p")).first()
    return C.page_of(pages, first["s"], first["p"]).select(F.md5("text").alias("sum"), F.coalesce(F.size("text_embedding"), F.lit(-1)).alias("dimension"))


def _stored_names(s, d):
    """Orders as names of page ranges: of a customer's document, in no order."""
    o = B.table(s, d, "orders")
    return o.select(c("o_orderkey").alias("name_id"), c("o_custkey").cast("string").alias("doc_id"), (c("o_orderkey") * 7 % 100003).cast("int").alias("start_page"), c("o_orderpriority").alias("suggested_name"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("user_final_name"))


@query
def q69_name_scan(s, d):
    rows = C.confirm_name(_stored_names(s, d), 7, "Final name")
    named = C.in_document_order(rows, "start_page", "name_id")  # names of one page in the order they came
    return named.select("doc_id", "nth", "start_page", "suggested_name", "status", "user_final_name")


@query
def q70_candidates_by_page(s, d):
    now = F.lit("2025-01-01").cast("timestamp")
    rows = C.set_status(C.candidate_rows(_candidates(s, d), now), "split_page", 5, "modified", now, page=6)
    return C.in_document_order(rows, "split_page").select("doc_id", "nth", "split_page", "status", "user_modified_page")


@query
def q71_append_queue(s, d):
    new = B.files(s, d).where("n % 4 = 0").select((c("n") + 10000000).alias("id"), F.concat(F.lit("/more"), "file_path").alias("file_path"), c("total_pages").alias("pages"), "size")
    return C.append_queue(_queue(s, d).withColumn("progress", F.lit(50)), new).select("id", "file_path", "pages", "size", "status", "progress")


@query
def q72_results_by_name(s, d):
    results = B.files(s, d).where("n % 3 = 0").select(F.concat(F.lit("C:\\out\\"), C.base_name(c("file_path"))).alias("file"), F.when(c("n") % 6 == 0, "failed").otherwise("complete").alias("status"))
    return C.results_by_name(_queue(s, d), results).select("id", "status")


@query
def q73_document_status(s, d):
    rows = B.files(s, d).select("doc_id", "n", F.lit("ocr_pending").alias("processing_status"), c("uploaded_at").alias("last_updated"))
    changes = rows.where("n % 3 = 0").select("doc_id", F.lit("ocr_complete").alias("status"))
    return C.set_document_status(rows, changes, F.lit("2025-01-01").cast("timestamp")).select("doc_id", "processing_status", F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


@query
def q74_name_chain(s, d):
    """Answers parsed, mended, and with the heuristic name where they give the fallback only."""
    segs = S.with_page_texts(_segments(s, d), B.text_bundle(s, d))
    k = c("segment_idx") % 4
    answer = F.when(k == 0, F.concat(F.lit("2024-01-31_Report_Pages from "), c("start_page").cast("string"))).when(k == 1, F.lit("\"bad Answer_x_y\"\nmore")).when(k == 2, F.lit("nothing of use")).otherwise(F.lit(""))
    name = X.name_of_answer(answer, c("start_page"))
    rows = segs.withColumn("given", F.when(name != X.fallback_name("document", c("start_page")), name))
    return S.named(rows, suggested="given").select("bundle_id", "segment_idx", "suggested_name", "naming")


@query
def q75_name_model(s, d):
    segs = S.with_page_texts(_segments(s, d), B.text_bundle(s, d))
    return S.suggest_names(segs, "name_stub").select("bundle_id", "segment_idx", "suggested_name", "naming")


@query
def q76_quality_report(s, d):
    return _metrics(s, d).select("doc_id", Q.quality_report(_m(), Q.confidence(_m())).alias("report"))


@query
def q77_prompt_key(s, d):
    return B.table(s, d, "part").select("p_partkey", X.prompt_key("naming", c("p_name"), c("p_brand")).alias("key"))


@query
def q78_machine(s, d):
    p = B.table(s, d, "part")
    return p.select("p_partkey", H.hybrid_mode(c("p_size") % 2 == 0, c("p_size") / 10, c("p_size") * F.lit(1.0)).alias("hybrid"), C.phase_percent(F.get(F.array(*map(F.lit, C.PHASES)), c("p_size") % 5), c("p_size"), F.lit(50)).alias("percent"))


@query
def q79_latest_status(s, d):
    return E.latest_status(_events(s, d), "key", F.struct("ts", "event_id"), "type").select("key", c("type").alias("status"))


@query
def q80_event_lines(s, d):
    return E.to_lines(B.table(s, d, "nation").select(F.lit("progress").alias("type"), c("n_name").alias("data")))


@query
def q81_forced_reasons(s, d):
    m = _metrics(s, d).withColumn("valid", Q.page_valid(_m(), Q.confidence(_m())))
    reasons = {"forced": Q.needs_ocr_reason(_m(), c("valid"), force=True), "overridden": Q.needs_ocr_reason(_m(), c("valid"), override=True), "kept": Q.needs_ocr_reason(_m(), c("valid"), force=True, override=False)}
    return m.select("doc_id", *(v.alias(k) for k, v in reasons.items()))


@query
def q82_input_validation(s, d):
    path = F.when(c("n") % 3 == 0, F.upper("file_path")).when(c("n") % 3 == 1, c("file_path")).otherwise(F.concat("file_path", F.lit(".txt")))
    from leafcut.sources.files import valid_inputs

    return valid_inputs(B.files(s, d).select("doc_id", "n", path.alias("path"))).select("doc_id", "path")


@query
def q83_vision_stub(s, d):
    v = M.apply_model(c("html").cast("binary"), "vision_stub", "array<float>")
    return B.table(s, d, "pages").select("page_id", v.alias("v")).select("page_id", F.size("v").alias("dimension"), F.round(V.dot(c("v"), c("v")), 3).alias("norm"))


__all__ = ["QUERIES"]
