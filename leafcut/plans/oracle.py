"""DuckDB SQL for the registered queries, on the same tables. Written apart from the DataFrame code, from the semantics."""

from __future__ import annotations

from leafcut.functions.text import COMMON_WORDS, DOCUMENT_TYPES, GARBAGE_PAGES, GARBAGE_WORDS, STRONG_WORDS, WEAK_WORDS, WS

NW = WS[1:]  # for use in a class that names more


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


B1 = "b1 AS (SELECT source AS bundle_id, doc_id, coalesce(text, '') AS text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_num FROM documents)"
B2 = "b2 AS (SELECT bundle_id, page_num, coalesce(embedding, list_transform(range(64), lambda x: 0.0::FLOAT))::DOUBLE[] AS v FROM b1 LEFT JOIN embeddings ON vec_id = doc_id)"
B3 = r"""b3 AS (SELECT 's' || l_suppkey AS bundle_id,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS page_num,
    CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'Page ' || l_linenumber WHEN 1 THEN 'see p. ' || CAST(l_quantity AS INTEGER)
        WHEN 2 THEN 'top' || chr(10) || l_linenumber || chr(10) || 'bottom' ELSE '- ' || l_linenumber || ' -' END AS text
    FROM lineitem)"""
B4 = "b4 AS (SELECT 'c' || conv_id AS bundle_id, CAST(turn AS INTEGER) AS page_num, coalesce(text, '') AS text FROM conversations)"
B7 = """b7 AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '/in/' || o_custkey || '.pdf' AS file_path, o_orderdate AS uploaded_at,
    CAST(coalesce(t.total_pages, 0) AS INTEGER) AS total_pages, o_orderkey AS n, CAST(trunc(o_totalprice) AS BIGINT) AS size
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total_pages FROM lineitem GROUP BY l_orderkey) t ON l_orderkey = o_orderkey)"""

PATTERNS = [rf"Page{WS}+(\d+)", rf"p\.{WS}*(\d+)", r"^(\d+)$", rf"[-\x{{2212}}]{WS}*(\d+){WS}*[-\x{{2212}}]"]
_n = [f"TRY_CAST(regexp_extract(text, '(?im){p}', 1) AS BIGINT)" for p in PATTERNS]
NUM = "CAST(coalesce(" + ", ".join(f"CASE WHEN {x} BETWEEN 1 AND 9999 THEN {x} END" for x in _n) + ") AS INTEGER)"

LINES = "string_split(text, chr(10))"
HEADER = f"CASE WHEN len({LINES}) >= 2 THEN {strip(LINES + '[1]')} ELSE '' END"
FOOTER = f"CASE WHEN len({LINES}) >= 2 THEN {strip(LINES + '[-1]')} ELSE '' END"
W = "(PARTITION BY bundle_id ORDER BY page_num)"

S_HEADER = f"""h0 AS (SELECT bundle_id, page_num, {HEADER} AS h, {FOOTER} AS f FROM b1),
h1 AS (SELECT *, lag(h) OVER {W} AS ph, lag(f) OVER {W} AS pf FROM h0),
h2 AS (SELECT bundle_id, page_num, coalesce(length(h) >= 3 AND length(ph) >= 3 AND h <> ph, false) AS hc, coalesce(length(f) >= 3 AND length(pf) >= 3 AND f <> pf, false) AS fc FROM h1),
s_header AS (SELECT bundle_id, page_num, CASE WHEN hc AND fc THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence,
    CASE WHEN hc AND fc THEN 'Header and footer changed' WHEN hc THEN 'Header changed' ELSE 'Footer changed' END AS reason, 1 AS det_ord FROM h2 WHERE hc OR fc)"""


def s_blank(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT bundle_id, page_num, length({strip('text')}) AS n FROM {source}),
{name}1 AS (SELECT *, lag(n) OVER {W} AS p FROM {name}0),
{name} AS (SELECT bundle_id, page_num, 0.85::DOUBLE AS confidence, 'Blank page before, length ' || p AS reason, 2 AS det_ord FROM {name}1 WHERE p < 10 AND n > 30)"""


S_NUMBER = f"""n0 AS (SELECT bundle_id, page_num, {NUM} AS num FROM SOURCE),
n1 AS (SELECT *, lag(num) OVER {W} AS p FROM n0),
s_number AS (SELECT bundle_id, page_num, CASE WHEN p >= 2 AND num = 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
    CASE WHEN p >= 2 AND num = 1 THEN 'Page number reset: ' ELSE 'Page number jump backward: ' END || p || ' -> ' || num AS reason, 0 AS det_ord
    FROM n1 WHERE (p >= 2 AND num = 1) OR num < p - 5)"""


def s_semantic(low: float, mid: float) -> str:
    return f"""v1 AS (SELECT bundle_id, page_num, round(list_dot_product(lag(v) OVER {W}, v), 6) AS sim FROM b2),
s_semantic AS (SELECT bundle_id, page_num, CASE WHEN sim < {low} THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
    CASE WHEN sim < {low} THEN 'Low similarity to the page before' ELSE 'Reduced similarity to the page before' END AS reason, 3 AS det_ord FROM v1 WHERE sim < {mid})"""


COMBINED = """g AS (SELECT bundle_id, page_num, count(*) AS signal_count, max(confidence) AS most, list(reason ORDER BY det_ord) AS signals FROM s_all GROUP BY bundle_id, page_num),
candidates AS (SELECT bundle_id, page_num, round(least(1.0::DOUBLE, most + least(0.2::DOUBLE, (signal_count - 1) * 0.1::DOUBLE)), 6) AS confidence, signals, signal_count FROM g),
kept AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'heuristic' ELSE 'clustering' END AS method FROM candidates WHERE confidence >= 0.3)"""

# Header, blank and semantic signals with low cut-offs.
CANDIDATES = f"WITH RECURSIVE {B1}, {B2}, {S_HEADER}, {s_blank('s_blank', 'b1')}, {s_semantic(0.0, 0.1)}, s_all AS (SELECT * FROM s_header UNION ALL SELECT * FROM s_blank UNION ALL SELECT * FROM s_semantic), {COMBINED}"


def segs(kept: str = "kept") -> str:
    return f"""totals AS (SELECT bundle_id, count(*) AS total FROM b1 GROUP BY bundle_id),
points AS (SELECT bundle_id, page_num, max(confidence) AS confidence FROM (
    SELECT k.bundle_id, page_num, confidence FROM {kept} k JOIN totals USING (bundle_id) WHERE confidence >= 0.5 AND page_num > 0 AND page_num < total
    UNION ALL SELECT bundle_id, 0, NULL FROM totals) GROUP BY ALL),
segs AS (SELECT bundle_id, CAST(row_number() OVER {W} - 1 AS INTEGER) AS segment_idx, page_num AS start_page,
    CAST(coalesce(lead(page_num) OVER {W}, total) - 1 AS INTEGER) AS end_page, CAST(coalesce(lead(page_num) OVER {W}, total) - page_num AS BIGINT) AS page_count, confidence
    FROM points JOIN totals USING (bundle_id))"""


SEGMENTS = f"WITH {B1}, {S_NUMBER.replace('SOURCE', 'b1')}, {S_HEADER}, {s_blank('s_blank', 'b1')}, s_all AS (SELECT * FROM s_number UNION ALL SELECT * FROM s_header UNION ALL SELECT * FROM s_blank), {COMBINED}, {segs()}"
TEXTS = """texts AS (SELECT s.*, coalesce(a.text, '') AS first_text, b.text AS second_text FROM segs s
    LEFT JOIN b1 a ON a.bundle_id = s.bundle_id AND a.page_num = s.start_page
    LEFT JOIN b1 b ON b.bundle_id = s.bundle_id AND b.page_num = s.start_page + 1 AND s.start_page + 1 <= s.end_page)"""


def clean(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def safe(x: str) -> str:
    out = rf"""regexp_replace({x}, '[<>:"/\\|?*]', '', 'g')"""
    out = f"regexp_replace(replace({out}, ' ', '_'), '_+', '_', 'g')"
    return rf"substr(regexp_replace({out}, '\A_+|_+\z', '', 'g'), 1, 100)"


def heuristic(text: str, ordinal: str) -> str:
    return f"CASE WHEN length({clean(text)}) > 10 AND length({safe(f'substr({clean(text)}, 1, 50)')}) > 0 THEN {safe(f'substr({clean(text)}, 1, 50)')} ELSE 'document_' || lpad(CAST({ordinal} AS VARCHAR), 4, '0') END"


def metrics(source: str, text: str, keys: str = "doc_id", name: str = "m") -> str:
    """CTEs up to ``name``: keys, the metrics, and ``conf``."""
    return rf"""{name}_t AS (SELECT {keys}, {text} AS t FROM {source}),
{name}_a AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '\pC')) - len(list_filter(regexp_extract_all(t, '\pC'), lambda x: regexp_matches(x, '{WS}'))) AS hidden,
    list_filter(regexp_extract_all(lower(t), '[\pL\pN_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS words FROM {name}_t),
{name}_b AS (SELECT *, CAST(n AS INTEGER) AS total_chars, CASE WHEN n > 0 THEN (n - hidden) / n ELSE 0 END AS printable_ratio,
    CASE WHEN n > 0 THEN {count('t', r'[\pL\pN]')} / n ELSE 0 END AS alphanumeric_ratio, CASE WHEN n > 0 THEN {count('t', WS)} / n ELSE 0 END AS whitespace_ratio,
    len(words) AS word_count, CASE WHEN len(words) > 0 THEN length(array_to_string(words, '')) / len(words) ELSE 0 END AS avg_word_length,
    len(list_filter(words, lambda x: x IN ({quoted(COMMON_WORDS)}))) AS common_words, {count('t', '[.!?]')} AS sentence_markers,
    {count('t', r'\x{FFFD}')} + {count('t', r'\x00')} + hidden AS unicode_errors, n / (612.0::DOUBLE * 792.0::DOUBLE) AS text_density FROM {name}_a),
{name} AS (SELECT *, CASE WHEN n > 0 THEN round(
    0.15::DOUBLE * least(printable_ratio / 0.95::DOUBLE, 1)
    + 0.15::DOUBLE * least(alphanumeric_ratio / 0.70::DOUBLE, 1)
    + 0.10::DOUBLE * CASE WHEN whitespace_ratio BETWEEN 0.10 AND 0.25 THEN 1 WHEN whitespace_ratio < 0.10 THEN whitespace_ratio / 0.10::DOUBLE ELSE greatest(0, 1 - (whitespace_ratio - 0.25::DOUBLE) / 0.15::DOUBLE) END
    + 0.15::DOUBLE * CASE WHEN avg_word_length BETWEEN 4 AND 7 THEN 1 WHEN avg_word_length >= 2 AND avg_word_length < 4 THEN (avg_word_length - 2) / 2.0::DOUBLE WHEN avg_word_length > 7 AND avg_word_length <= 15 THEN greatest(0, 1 - (avg_word_length - 7) / 8.0::DOUBLE) ELSE 0 END
    + 0.10::DOUBLE * least(word_count / 50.0::DOUBLE, 1)
    + 0.15::DOUBLE * CASE WHEN word_count > 0 THEN least(common_words / word_count / 0.10::DOUBLE, 1) ELSE 0 END
    + 0.10::DOUBLE * greatest(0, 1 - 10 * unicode_errors / n)
    + 0.10::DOUBLE * CASE WHEN text_density BETWEEN 0.001 AND 0.1 THEN 1 WHEN text_density < 0.001 THEN text_density / 0.001::DOUBLE ELSE greatest(0, 1 - (text_density - 0.1::DOUBLE) / 0.1::DOUBLE) END, 6) ELSE 0 END AS conf FROM {name}_b)"""


VALID = "(total_chars >= 100 AND printable_ratio >= 0.85 AND alphanumeric_ratio >= 0.60 AND whitespace_ratio <= 0.40 AND word_count >= 10 AND avg_word_length BETWEEN 2 AND 20 AND conf >= 0.65 AND text_density >= 0.001)"
DOCS = f"WITH {metrics('documents', strip("coalesce(text, '')"))}"
GEOMETRY = """box AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount > 0.05 AS has_images,
    (576 - 36) * (36 + l_quantity * 16 - 36) * CASE WHEN 36 + l_quantity * 16 <= 792 THEN 1 ELSE (792 - 36) / (l_quantity * 16) END + 300.0::DOUBLE * (792 - 760) AS ta,
    CASE WHEN l_discount > 0.05 THEN 512.0::DOUBLE * (least(792, 400 + l_tax * 4000) - 400) ELSE 0 END AS ia FROM lineitem),
cov AS (SELECT *, round(least(1, ta / 484704.0::DOUBLE), 6) AS text_coverage, round(least(1, ia / 484704.0::DOUBLE), 6) AS image_coverage, round(greatest(0, 1 - least(1, (ta + ia) / 484704.0::DOUBLE)), 6) AS uncovered FROM box)"""
COV_CONF = """round(greatest(0, least(1, CASE WHEN text_coverage >= 0.8 THEN 1 WHEN text_coverage >= 0.6 THEN 0.9::DOUBLE WHEN text_coverage >= 0.4 THEN 0.7::DOUBLE WHEN text_coverage >= 0.2 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END
    * CASE WHEN has_images AND uncovered > 0.3 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN text_coverage < 0.5 THEN 0.6::DOUBLE ELSE 1 END)), 6)"""


def page_reason(x: str) -> str:
    return rf"CASE WHEN length({strip(x)}) = 0 THEN 'empty' WHEN {count(x, r'[\pL\pN]')} / length({x}) < 0.3 THEN 'low alphanumeric ratio' WHEN {strip(x)} IN ({quoted(GARBAGE_PAGES)}) THEN 'garbage pattern' END"


RESPONSES = """r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'YES - ' WHEN 1 THEN 'no: ' WHEN 2 THEN '  Yes: clear boundary, ' WHEN 3 THEN 'NO - maybe unclear ' ELSE 'Perhaps ' END
    || coalesce(text, '') AS response, CAST(turn % 4 + 1 AS INTEGER) AS signal_count FROM conversations)"""


def _tail(n: int) -> str:
    return strip(rf"regexp_replace({strip(f'substr(s, {n + 1})')}, '\A[-:]', '')")


_score = " ".join(f"{'+' if up else '-'} 0.05::DOUBLE * ({' + '.join(f'CAST(contains(lower(llm_reason), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in words)})" for words, up in ((STRONG_WORDS, True), (WEAK_WORDS, False)))
DECIDED = f"""r1 AS (SELECT *, {strip('response')} AS s FROM r),
r2 AS (SELECT *, starts_with(upper(s), 'YES') AS llm_decision, CASE WHEN starts_with(upper(s), 'YES') THEN {_tail(3)} WHEN starts_with(upper(s), 'NO') THEN {_tail(2)} ELSE 'Unclear response: ' || s END AS llm_reason FROM r1),
d AS (SELECT *, round(greatest(0, least(1, CASE WHEN llm_decision THEN 0.7::DOUBLE + least(signal_count * 0.05::DOUBLE, 0.2::DOUBLE) ELSE 0.6::DOUBLE - least(signal_count * 0.03::DOUBLE, 0.15::DOUBLE) END {_score})), 6) AS llm_confidence FROM r2)"""
NAMES = rf"""nm AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '2024-01-31_Invoice_' WHEN 1 THEN 'UNDATED_Letter_' WHEN 2 THEN '  "2023-1-5_Bad type_' WHEN 3 THEN '2020-12-01_Report' ELSE 'UNDATED_Form_x_' END
    || regexp_replace(text, '[^a-zA-Z ]', '', 'g') || CASE WHEN turn % 2 = 0 THEN '.PDF' ELSE '"' END AS response FROM conversations WHERE text IS NOT NULL),
parsed AS (SELECT conv_id, turn, {strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip(f'string_split({strip('response')}, chr(10))[1]')}, '" + r"""\A["'']+|["'']+\z""" + f"', '', 'g'), '" + r"(?i)\.pdf\z" + f"', ''), '[^" + r"\pL\pN_\-" + f"{NW}', '', 'g'), '{WS}+', ' ', 'g')")} AS name FROM nm),
parts AS (SELECT *, string_split(name, '_') AS p FROM parsed)"""
DATE_OK = r"(p[1] = 'UNDATED' OR regexp_full_match(p[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}'))"
TYPE_OK = r"regexp_full_match(p[2], '[\pL\pN_]+')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda x: length(x) > 0)"


STORED = "pg AS (SELECT source AS doc_id, doc_id AS n, CAST(doc_id AS INTEGER) AS page_num, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"
QUEUE = f"WITH {B7}, q AS (SELECT n AS id, file_path, total_pages AS pages, size, CASE n % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'complete' END AS status FROM b7)"
LOG = "lg AS (SELECT event_id AS log_id, CAST(user_id AS VARCHAR) AS doc_id, event_type AS phase, CASE WHEN value < 20 THEN 'failed' WHEN value < 60 THEN 'started' ELSE 'completed' END AS status, ts FROM events)"
EVENTS = "WITH ev AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'progress' WHEN 1 THEN 'result' WHEN 2 THEN 'info' ELSE 'error' END AS type, ts, CAST(user_id AS VARCHAR) AS key FROM events)"


def table_step(x: str, table: list[tuple], op: str = "<") -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {v}" for b, v in table[:-1]) + f" ELSE {table[-1][1]} END"


CLUSTERS = f"""WITH RECURSIVE {B1}, {B2},
eps AS (SELECT a.bundle_id, a.page_num AS i, b.page_num AS j FROM b2 a JOIN b2 b ON a.bundle_id = b.bundle_id AND a.page_num <> b.page_num AND round(list_dot_product(a.v, b.v), 6) >= 0.25),
reach AS (SELECT bundle_id, page_num AS i, page_num AS j FROM b2 UNION SELECT r.bundle_id, r.i, e.j FROM reach r JOIN eps e ON e.bundle_id = r.bundle_id AND e.i = r.j),
root AS (SELECT bundle_id, i AS page_num, min(j) AS r FROM reach GROUP BY bundle_id, i),
labels AS (SELECT bundle_id, page_num, CAST(dense_rank() OVER (PARTITION BY bundle_id ORDER BY r) - 1 AS INTEGER) AS label FROM root),
lab1 AS (SELECT *, lag(label) OVER {W} AS was FROM labels),
s_cluster AS (SELECT bundle_id, page_num, 0.6::DOUBLE AS confidence, 'Cluster changed' AS reason, 4 AS det_ord FROM lab1 WHERE was <> label)"""


def prompt_context(name: str = "ctx") -> str:
    t = "substr(text, 1, 300)"
    return f"""around AS (SELECT bundle_id, page_num, coalesce(list({t}) OVER (PARTITION BY bundle_id ORDER BY page_num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS before,
    list({t}) OVER (PARTITION BY bundle_id ORDER BY page_num ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS after FROM b1),
{name} AS (SELECT k.*, before, after FROM kept k LEFT JOIN around USING (bundle_id, page_num))"""


_side = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, chr(10) || '---' || chr(10)) ELSE '(none)' END"
PROMPT = f"'Does a new document start at page ' || (page_num + 1) || '?' || chr(10) || 'Signals:' || chr(10) || array_to_string(list_transform(signals, lambda s: '- ' || s), chr(10)) || chr(10) || 'Pages before:' || chr(10) || {_side('before')} || chr(10) || 'Pages from there:' || chr(10) || {_side('after')} || chr(10) || 'Answer YES or NO - reason.'"

ORACLE_SQL: dict[str, str] = {
    "q01_page_number_extract": f"WITH {B3} SELECT bundle_id, page_num, {NUM} AS num FROM b3",
    "q02_page_number_reset": f"WITH {B3}, {S_NUMBER.replace('SOURCE', 'b3')} SELECT * FROM s_number",
    "q03_header_footer_change": f"WITH {B1}, {S_HEADER} SELECT * FROM s_header",
    "q04_blank_separator": f"WITH {B1}, {B4}, u AS (SELECT bundle_id, page_num, text FROM b1 UNION ALL SELECT * FROM b4), {s_blank('s_blank', 'u')} SELECT * FROM s_blank",
    "q05_semantic_discontinuity": f"WITH {B1}, {B2}, {s_semantic(0.3, 0.5)} SELECT * FROM s_semantic",
    "q06_similarity_matrix": f"""WITH {B1}, {B2}, u AS (SELECT bundle_id, page_num, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8::DOUBLE)) AS v FROM b2)
        SELECT a.bundle_id, a.page_num AS i, b.page_num AS j, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b USING (bundle_id)""",
    "q07_cluster_labels": f"{CLUSTERS} SELECT * FROM labels",
    "q08_cluster_boundary": f"{CLUSTERS} SELECT * FROM s_cluster",
    "q09_combine_signals": f"{CANDIDATES} SELECT bundle_id, page_num, confidence, array_to_string(signals, '|') AS signals, signal_count, method FROM kept",
    "q10_segments": f"{SEGMENTS} SELECT * FROM segs",
    "q11_segment_report": f"{SEGMENTS}, {TEXTS} SELECT bundle_id, segment_idx, start_page, end_page, page_count, length(first_text) AS first_chars, length(second_text) AS second_chars FROM texts",
    "q12_heuristic_names": f"{SEGMENTS}, {TEXTS} SELECT bundle_id, segment_idx, {heuristic('first_text', 'segment_idx + 1')} AS suggested_name FROM texts",
    "q13_unique_names": f"""WITH {B1}, x AS (SELECT bundle_id, page_num AS segment_idx, CASE WHEN page_num % 4 < 2 THEN 'a' WHEN page_num % 4 = 2 THEN 'a_1' ELSE {safe('text')} END AS suggested_name FROM b1),
        y AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, suggested_name ORDER BY segment_idx) - 1 AS k FROM x)
        SELECT bundle_id, segment_idx, suggested_name, suggested_name || CASE WHEN suggested_name = 'a_1' THEN '_' || (k + 1) WHEN k > 0 THEN '_' || k ELSE '' END || '.pdf' AS output_filename FROM y""",
    "q14_text_metrics": f"""{DOCS} SELECT doc_id, total_chars, round(printable_ratio, 6) AS printable_ratio, round(alphanumeric_ratio, 6) AS alphanumeric_ratio, round(whitespace_ratio, 6) AS whitespace_ratio,
        CAST(word_count AS INTEGER) AS word_count, round(avg_word_length, 6) AS avg_word_length, CAST(common_words AS INTEGER) AS common_words, CAST(sentence_markers AS INTEGER) AS sentence_markers, CAST(unicode_errors AS INTEGER) AS unicode_errors, round(text_density, 6) AS text_density FROM m""",
    "q15_text_confidence": f"{DOCS} SELECT doc_id, conf AS confidence FROM m",
    "q16_page_validity": f"{DOCS} SELECT doc_id, {VALID} AS valid FROM m",
    "q17_invalid_reason": f"""{DOCS}, e AS (SELECT *, list_filter([CASE WHEN total_chars < 100 THEN 'too few characters' END, CASE WHEN printable_ratio < 0.85 THEN 'low printable ratio' END, CASE WHEN alphanumeric_ratio < 0.60 THEN 'low alphanumeric ratio' END,
        CASE WHEN unicode_errors > 0 THEN 'unicode errors' END, CASE WHEN common_words < 5 THEN 'few common words' END, CASE WHEN text_density < 0.001 THEN 'low text density' END], lambda x: x IS NOT NULL) AS causes FROM m)
        SELECT doc_id, CASE WHEN NOT {VALID} THEN 'OCR needed: ' || CASE WHEN len(causes) > 0 THEN array_to_string(causes, ', ') ELSE 'low confidence' END END AS reason FROM e""",
    "q18_structure_sample": f"""WITH {B1}, {metrics('b1', strip('text'), 'bundle_id, page_num')},
        k AS (SELECT bundle_id, count(*) AS n, least(10, count(*)) AS k FROM b1 GROUP BY bundle_id),
        picks AS (SELECT bundle_id, n AS total, k, CAST(floor(i * n / k) AS INTEGER) AS page_num FROM (SELECT *, unnest(range(k)) AS i FROM k)),
        a AS (SELECT p.bundle_id, total, k, count(*) FILTER ({VALID}) AS valid_samples, round(sum(conf) / max(k), 6) AS avg_confidence FROM picks p JOIN m ON m.bundle_id = p.bundle_id AND m.page_num = p.page_num GROUP BY ALL)
        SELECT bundle_id, total AS total_pages, k AS sample_size, valid_samples, avg_confidence, valid_samples < k / 2 AS needs_ocr, valid_samples > 0 AS has_valid, CASE WHEN valid_samples < k / 2 THEN total ELSE 0 END AS ocr_pages_estimated FROM a""",
    "q19_coverage": f"WITH {GEOMETRY} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, has_images, text_coverage, image_coverage, uncovered FROM cov",
    "q20_coverage_confidence": f"""WITH {GEOMETRY}, e AS (SELECT *, {COV_CONF} AS coverage_confidence FROM cov)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coverage_confidence, round(CASE WHEN coverage_confidence < 0.5 THEN 0.75::DOUBLE * coverage_confidence ELSE 0.75::DOUBLE END, 6) AS adjusted FROM e""",
    "q21_ocr_output_validity": f"WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, ({page_reason('t')}) IS NULL AS valid, {page_reason('t')} AS reason FROM x",
    "q22_replace_decision": f"""WITH {metrics('documents', "coalesce(text, '')", name='o')}, {metrics('documents', "regexp_replace(coalesce(text, ''), '[aeiou]', '', 'g')", name='r')}
        SELECT o.doc_id, o.conf AS original_confidence, r.conf AS ocr_confidence, CASE WHEN length({strip('o.t')}) = 0 THEN true WHEN o.conf >= 0.7 THEN round(r.conf - o.conf, 6) > 0.05 ELSE r.conf > o.conf END AS replace FROM o JOIN r USING (doc_id)""",
    "q23_ocr_retry_ladder": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'good text' WHEN 1 THEN 'second ' || event_type WHEN 2 THEN 'third ' || event_type WHEN 3 THEN 'third ' || event_type ELSE '' END AS text,
        CASE event_id % 6 WHEN 0 THEN 'primary_400' WHEN 1 THEN 'second_300' WHEN 2 THEN 'second_400' WHEN 3 THEN 'second_400' ELSE 'ALL_FAILED' END AS engine FROM events""",
    "q24_line_aggregate": f"""WITH x AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length({strip('x')}) > 0) AS l FROM documents)
        SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(coalesce(length(array_to_string(l, chr(10))), 0) AS INTEGER) AS n_chars,
        CASE WHEN len(l) > 0 THEN round(list_sum(list_transform(l, lambda x: (length(x) % 100) / 100.0::DOUBLE)) / len(l), 6) ELSE 0 END AS confidence FROM x""",
    "q25_word_aggregate": rf"""WITH x AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) * 17 % 101 > 60 AND length(w) > 0 AND {count('w', r'[\pL\pN]')} / greatest(length(w), 1) >= 0.5 AND {strip('w')} NOT IN ({quoted(GARBAGE_WORDS)}) AND {count('w', '[.,!?;:]')} < length(w)) AS k FROM documents)
        SELECT doc_id, CAST(len(k) AS INTEGER) AS n_words, CAST(coalesce(length(array_to_string(k, ' ')), 0) AS INTEGER) AS n_chars, CASE WHEN len(k) > 0 THEN round(list_sum(list_transform(k, lambda w: length(w) * 17 % 101)) / len(k) / 100, 6) ELSE 0 END AS confidence FROM x""",
    "q26_context_pages": f"{CANDIDATES}, {prompt_context()} SELECT bundle_id, page_num, coalesce(array_to_string(before, '|'), '') AS before, array_to_string(after, '|') AS after FROM ctx",
    "q27_split_prompt": f"{CANDIDATES}, {prompt_context()} SELECT bundle_id, page_num, md5({PROMPT}) AS prompt FROM ctx",
    "q28_naming_prompt": f"""{SEGMENTS}, {TEXTS} SELECT bundle_id, segment_idx, md5('Name this document as DATE_TYPE_DESCRIPTION.' || chr(10) || 'Types: {", ".join(DOCUMENT_TYPES)}' || chr(10) || 'First page:' || chr(10) || substr(first_text, 1, 2000)
        || CASE WHEN second_text IS NOT NULL THEN chr(10) || 'Second page:' || chr(10) || substr(second_text, 1, 1000) ELSE '' END) AS prompt FROM texts""",
    "q29_parse_decision": f"WITH {RESPONSES}, {DECIDED} SELECT conv_id, turn, llm_decision AS should_split, llm_reason AS reason FROM d",
    "q30_llm_confidence": f"WITH {RESPONSES}, {DECIDED} SELECT conv_id, turn, llm_confidence FROM d",
    "q31_llm_filter": f"WITH {RESPONSES}, {DECIDED} SELECT conv_id, turn, llm_confidence AS confidence, signal_count + 1 AS signal_count, 'x|LLM: ' || llm_reason AS signals FROM d WHERE llm_decision AND llm_confidence >= 0.6",
    "q32_parse_filename": f"WITH {NAMES} SELECT conv_id, turn, name FROM parts",
    "q33_validate_filename": f"WITH {NAMES} SELECT conv_id, turn, coalesce(len(p) >= 3 AND {DATE_OK} AND {TYPE_OK} AND len({words('array_to_string(p[3:], chr(32))')}) BETWEEN 2 AND 5, false) AS valid FROM parts",
    "q34_fix_filename": rf"""WITH {NAMES}, e AS (SELECT *, {words("regexp_replace(array_to_string(p[3:], ' '), '[^" + r"\pL\pN_\-" + NW + "', '', 'g')")} AS w FROM parts)
        SELECT conv_id, turn, CASE WHEN len(p) < 3 THEN 'UNDATED_Other_document ' || (turn + 1) ELSE CASE WHEN {DATE_OK} THEN p[1] ELSE 'UNDATED' END || '_' || CASE WHEN {TYPE_OK} THEN p[2] ELSE 'Other' END || '_' || CASE WHEN len(w) < 2 THEN 'document Document' ELSE array_to_string(w[1:5], ' ') END END AS fixed FROM e""",
    "q35_name_metadata": f"WITH {NAMES} SELECT conv_id, turn, CASE WHEN len(p) >= 3 THEN p[1] ELSE 'UNDATED' END AS date, CASE WHEN len(p) >= 3 THEN p[2] ELSE 'Other' END AS doctype, CASE WHEN len(p) >= 3 THEN array_to_string(p[3:], '_') ELSE name END AS description FROM parts",
    "q36_latest_by_path": f"WITH {B7} SELECT file_path, doc_id, uploaded_at FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY uploaded_at DESC, n DESC) AS k FROM b7) WHERE k = 1",
    "q37_last_phase": f"WITH {LOG} SELECT doc_id, phase AS last_phase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, log_id DESC) AS k FROM lg WHERE status = 'completed') WHERE k = 1",
    "q38_cache_stats": f"""WITH {B7}, {STORED}, a AS (SELECT count(*) AS n_documents, min(uploaded_at) AS oldest FROM b7), b AS (SELECT CAST(sum(len(embedding) * 4) AS BIGINT) AS embedding_bytes, CAST(sum(length(text)) AS BIGINT) AS text_bytes, count(embedding) AS n_embeddings FROM pg)
        SELECT *, round(embedding_bytes / 1048576, 2) AS embedding_mb, round(text_bytes / 1048576, 2) AS text_mb FROM a, b""",
    "q39_completeness": f"WITH {STORED}, a AS (SELECT doc_id, count(*) AS total_pages, count(embedding) AS n_embedded FROM pg GROUP BY doc_id) SELECT doc_id, total_pages, n_embedded, n_embedded = total_pages AS has_all, n_embedded >= total_pages * 0.8 AS enough, n_embedded >= total_pages * 0.5 AS half FROM a",
    "q40_upsert_pages": f"""WITH {STORED}, w AS (
            SELECT doc_id, CASE WHEN n % 10 = 0 THEN page_num + 1000000 ELSE page_num END AS page_num, n % 6 = 0 AS twice,
                CASE WHEN n % 6 = 0 THEN 'again ' || text WHEN n % 4 = 0 THEN 'new ' || text ELSE text END AS text FROM pg WHERE n % 2 = 0)
        SELECT doc_id, page_num, CAST(length(CASE WHEN w.doc_id IS NULL THEN pg.text ELSE w.text END) AS INTEGER) AS text_length, md5(CASE WHEN w.doc_id IS NULL THEN pg.text ELSE w.text END) AS sum,
            w.doc_id IS NOT NULL OR n % 3 = 0 AS has_text_layer, CASE WHEN w.doc_id IS NULL THEN CASE WHEN n % 3 = 0 THEN 'text_layer' ELSE 'ocr' END WHEN twice THEN 'again' ELSE 'new' END AS ocr_method,
            CASE WHEN w.doc_id IS NULL THEN n % 100 / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS ocr_confidence, embedding IS NOT NULL AND (w.doc_id IS NULL OR w.text IS NOT DISTINCT FROM pg.text) AS embedded,
            CASE WHEN w.doc_id IS NULL THEN 'f' || n END AS features, CASE WHEN w.doc_id IS NULL THEN '2025-01-01' WHEN twice THEN '2025-01-03' ELSE '2025-01-02' END AS day
        FROM pg FULL JOIN w USING (doc_id, page_num)""",
    "q41_update_embeddings": f"WITH {STORED} SELECT doc_id, page_num, CAST(CASE WHEN n % 3 = 0 THEN 1 ELSE coalesce(len(embedding), -1) END AS INTEGER) AS dimension FROM pg",
    "q42_expire": f"WITH {B7} SELECT doc_id, uploaded_at FROM b7 WHERE uploaded_at >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY",
    "q43_delete_cascade": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) AS n_children FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey",
    "q44_candidate_scan": f"{CANDIDATES} SELECT bundle_id AS doc_id, page_num AS split_page, confidence, method AS detection_method, array_to_string(signals, '|') AS signals, CAST(signal_count AS INTEGER) AS signal_count FROM kept WHERE page_num % 2 <> 0",
    "q45_status_counts": f"{QUEUE} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM q",
    "q46_queue_sort": f"{QUEUE} SELECT id, status FROM q ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 WHEN 'complete' THEN 2 ELSE 3 END DESC, id",
    "q47_batch_stats": f"{QUEUE} SELECT count(*) AS files, count(*) FILTER (status = 'complete') AS ok, count(*) FILTER (status = 'failed') AS failed, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages) * 0.25 AS DOUBLE) AS seconds, 4.0::DOUBLE AS pages_per_second FROM q",
    "q48_method_counts": f"{DOCS} SELECT CASE WHEN {VALID} THEN 'text_layer' ELSE 'ocr' END AS method, count(*) AS pages FROM m GROUP BY ALL",
    "q49_batches": f"WITH {B1} SELECT bundle_id, page_num, CAST(page_num // 10 AS INTEGER) AS batch FROM b1",
    "q50_step_functions": f"""WITH p AS (SELECT *, p_size / 4 AS gb, p_size / 50.0::DOUBLE AS used FROM part),
        r AS (SELECT *, CASE WHEN used >= 0.95 THEN 'critical' WHEN used >= 0.85 THEN 'high' WHEN used >= 0.75 THEN 'medium' WHEN used >= 0.60 THEN 'low' ELSE 'none' END AS pressure FROM p)
        SELECT p_partkey, {table_step('gb', [(1.5, 5), (2.5, 8), (3.5, 15), (5, 25), (7, 35), (10, 50), (0, 60)])} AS gpu_batch, {table_step('gb * 3', [(6, 3), (10, 5), (20, 10), (28, 15), (0, 20)])} AS cpu_batch,
        least(450, {table_step('gb', [(2, 200), (4, 300), (6, 400), (0, 600)])}) AS gpu_dpi, least(600, {table_step('gb * 3', [(6, 150), (10, 200), (20, 300), (0, 450)])}) AS cpu_dpi, pressure,
        CAST(CASE pressure WHEN 'critical' THEN greatest(1, p_size // 4) WHEN 'high' THEN greatest(1, p_size // 2) WHEN 'medium' THEN greatest(1, floor(p_size * 0.75)) WHEN 'low' THEN p_size ELSE least(p_size + 5, p_size * 2) END AS INTEGER) AS batch,
        {table_step('gb', [(2, "'cpu'"), (4, "'2gb'"), (6, "'4gb'"), (8, "'6gb'"), (0, "'8gb'")])} AS tier, round(p_size / 25.0::DOUBLE + 2, 6) AS seconds FROM r""",
    "q51_progress_eta": """WITH e AS (SELECT event_id, event_id % 50 AS c, 40 * (event_id % 3) AS t, value AS v FROM events)
        SELECT event_id, CASE WHEN t > 0 THEN round(c / t * 100, 6) ELSE 0 END AS percent, CASE WHEN c > 0 AND v > 0 THEN round((t - c) / (c / v), 6) ELSE 0 END AS eta FROM e""",
    "q53_event_routing": f"{EVENTS} SELECT 'python_' || type AS channel, count(*) AS n, count(DISTINCT key) AS keys FROM ev WHERE type IN ('progress', 'result', 'error') GROUP BY type",
    "q54_progress_throttle": """WITH RECURSIVE p AS (SELECT event_id, event_id * 150 + event_id % 7 * 130 AS ms, CAST(event_id // 4 % 2 AS VARCHAR) AS key, event_id % 40 = 0 AS force FROM events WHERE event_id % 4 = 0),
        went AS (SELECT key, min(ms) AS ms FROM p WHERE NOT force GROUP BY key
            UNION ALL SELECT w.key, (SELECT min(p.ms) FROM p WHERE NOT p.force AND p.key = w.key AND p.ms >= w.ms + 2000) FROM went w WHERE w.ms IS NOT NULL)
        SELECT key, event_id FROM p JOIN went USING (key, ms) WHERE NOT force UNION ALL SELECT key, event_id FROM p WHERE force""",
    "q58_effective_text": f"""WITH {B1}, {metrics('b1', strip('text'), 'bundle_id, page_num, text')}, e AS (SELECT bundle_id, page_num, {VALID} AS ok, CASE WHEN {VALID} THEN text WHEN page_num % 2 = 0 THEN 'OCR ' || text ELSE '' END AS x FROM m)
        SELECT bundle_id, page_num, length(x) AS chars, md5(x) AS sum, CASE WHEN ok THEN 'text_layer' ELSE 'ocr' END AS ocr_method FROM e""",
    "q59_debundle_full": f"""{CLUSTERS}, {S_NUMBER.replace('SOURCE', 'b1')}, {S_HEADER}, {s_blank('s_blank', 'b1')}, {s_semantic(0.0, 0.1)},
        s_all AS (SELECT * FROM s_number UNION ALL SELECT * FROM s_header UNION ALL SELECT * FROM s_blank UNION ALL SELECT * FROM s_semantic UNION ALL SELECT * FROM s_cluster), {COMBINED}, {segs()}, {TEXTS},
        nn AS (SELECT *, {heuristic('first_text', 'segment_idx + 1')} AS suggested_name FROM texts),
        un AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, suggested_name ORDER BY segment_idx) - 1 AS k FROM nn)
        SELECT bundle_id, segment_idx, start_page, end_page, page_count, confidence, suggested_name, suggested_name || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.pdf' AS output_filename FROM un""",
    "q60_pages_to_segments": f"{SEGMENTS} SELECT b1.bundle_id, b1.page_num, segment_idx FROM b1 JOIN segs ON b1.bundle_id = segs.bundle_id AND b1.page_num BETWEEN start_page AND end_page",
    "q61_segment_summary": f"{SEGMENTS} SELECT bundle_id, count(*) AS segments, CAST(sum(page_count) AS BIGINT) AS pages, max(page_count) AS longest FROM segs GROUP BY bundle_id",
    "q62_approved_pages": f"WITH {RESPONSES}, {DECIDED} SELECT CAST(conv_id AS VARCHAR) AS bundle_id, array_to_string(list_sort(list(DISTINCT turn)), ',') AS pages FROM d WHERE llm_decision AND llm_confidence >= 0.6 GROUP BY conv_id",
    "q63_queue_state": f"{QUEUE} SELECT bool_or(status = 'processing') AS any_processing, count(*) = 0 AS empty FROM q",
    "q64_update_queue": f"{QUEUE} SELECT id, CASE WHEN id % 3 = 0 THEN 'complete' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 100 ELSE 10 END AS progress, CASE WHEN id % 3 = 0 THEN NULL ELSE 'old' END AS error FROM q",
    "q65_model_usage": f"WITH {RESPONSES} SELECT count(*) AS total, count(*) FILTER (turn % 6 = 5) AS failed, count(*) FILTER (turn % 6 <> 5) AS ok, CAST(sum(len({words('response')})) FILTER (turn % 6 <> 5) AS BIGINT) AS tokens FROM r",
    "q66_resume": f"""WITH {LOG}, x AS (SELECT doc_id, log_id % 5 AS ph, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, log_id DESC) AS k FROM lg WHERE status = 'completed')
        SELECT doc_id, ['ocr', 'embeddings', 'split_detection', 'extraction', 'complete'][ph + 1] AS last_phase, ph >= 0 AS skip_ocr, ph >= 2 AS skip_splits FROM x WHERE k = 1""",
}
SUGGESTED = f"""{SEGMENTS}, {TEXTS}, sg AS (SELECT *, CASE segment_idx % 4 WHEN 0 THEN '2024-01-31_Report_Pages from ' || start_page WHEN 1 THEN 'UNDATED_x_document Document' END AS given FROM texts)"""
ORACLE_SQL |= {
    "q67_point_lookup": f"WITH {B7} SELECT doc_id, file_path, total_pages, size FROM b7 WHERE doc_id = '7'",
    "q68_page_lookup": "SELECT md5(text) AS sum, CAST(coalesce(len(embedding), -1) AS INTEGER) AS dimension FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id = (SELECT min(doc_id) FROM documents)",
    "q69_name_scan": """SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 7 % 100003) - 1 AS INTEGER) AS nth, CAST(o_orderkey * 7 % 100003 AS INTEGER) AS start_page, o_orderpriority AS suggested_name,
        CASE WHEN o_orderkey = 7 THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN o_orderkey = 7 THEN 'Final name' END AS user_final_name FROM orders""",
    "q70_candidates_by_page": f"{CANDIDATES} SELECT bundle_id AS doc_id, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY page_num) - 1 AS INTEGER) AS nth, page_num AS split_page, CASE WHEN page_num = 5 THEN 'modified' ELSE 'pending' END AS status, CASE WHEN page_num = 5 THEN 6 END AS user_modified_page FROM kept",
    "q71_append_queue": f"{QUEUE} SELECT id, file_path, pages, size, status, 50 AS progress FROM q UNION ALL SELECT n + 10000000, '/more' || file_path, total_pages, size, 'pending', 0 FROM b7 WHERE n % 4 = 0",
    "q72_results_by_name": f"{QUEUE}, r AS (SELECT file_path, bool_or(n % 6 = 0) AS failed FROM b7 WHERE n % 3 = 0 GROUP BY file_path) SELECT id, CASE WHEN failed THEN 'failed' WHEN NOT failed THEN 'complete' ELSE status END AS status FROM q LEFT JOIN r USING (file_path)",
    "q73_document_status": f"WITH {B7} SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'ocr_complete' ELSE 'ocr_pending' END AS processing_status, CASE WHEN n % 3 = 0 THEN '2025-01-01' ELSE strftime(uploaded_at, '%Y-%m-%d') END AS day FROM b7",
    "q74_name_chain": f"{SUGGESTED} SELECT bundle_id, segment_idx, coalesce(given, {heuristic('first_text', 'segment_idx + 1')}) AS suggested_name, CASE WHEN given IS NULL THEN 'heuristic' ELSE 'model' END AS naming FROM sg",
    "q76_quality_report": f"{DOCS} SELECT doc_id, printf('chars %d, words %d, printable %.2f, alphanumeric %.2f, confidence %.2f: ', total_chars, CAST(word_count AS INTEGER), CAST(printable_ratio AS DOUBLE), CAST(alphanumeric_ratio AS DOUBLE), CAST(conf AS DOUBLE)) || CASE WHEN conf >= 0.65 THEN 'VALID' ELSE 'INVALID' END AS report FROM m",
    "q77_prompt_key": """SELECT p_partkey, 'llm_naming_' || md5('{"p0":"' || p_name || '","p1":"' || p_brand || '"}') AS key FROM part""",
    "q78_machine": """WITH x AS (SELECT *, p_size % 5 AS ph, p_size / 50.0::DOUBLE AS share FROM part)
        SELECT p_partkey, p_size % 2 = 0 AND p_size / 10 <= 4.5 AND p_size >= 15 AS hybrid,
        CAST(CASE ph WHEN 0 THEN 5 + floor(share * 25) WHEN 1 THEN 30 + floor(share * 20) WHEN 2 THEN 50 + floor(share * 15) WHEN 3 THEN 80 + floor(share * 15) ELSE 100 END AS INTEGER) AS percent FROM x""",
    "q79_latest_status": f"{EVENTS} SELECT key, arg_max(type, (ts, event_id)) AS status FROM ev GROUP BY key",
    "q80_event_lines": """SELECT '{"type":"progress","data":"' || n_name || '"}' AS value FROM nation""",
    "q81_forced_reasons": "SELECT doc_id, 'forced' AS forced, 'override' AS overridden, CAST(NULL AS VARCHAR) AS kept FROM documents",
    "q82_input_validation": f"WITH {B7} SELECT doc_id, CASE n % 3 WHEN 0 THEN upper(file_path) ELSE file_path END AS path FROM b7 WHERE n % 3 < 2",
}


def _size(n: str) -> str:
    unit = f"CASE WHEN {n} < 1024 THEN 0 WHEN {n} < 1048576 THEN 1 WHEN {n} < 1073741824 THEN 2 ELSE 3 END"
    value = f"CAST(CAST(round({n} / pow(1024.0::DOUBLE, {unit}), 2) AS DECIMAL(20, 2)) AS VARCHAR)"
    return rf"CASE WHEN {n} = 0 THEN '0 B' ELSE regexp_replace(regexp_replace({value}, '0+\z', ''), '\.\z', '') || ' ' || ['B', 'KB', 'MB', 'GB'][{unit} + 1] END"


ORACLE_SQL["q52_size_format"] = f"SELECT o_orderkey, {_size('CAST(trunc(o_totalprice) AS BIGINT)')} AS size, {_size('(o_orderkey * 1048576)')} AS big FROM orders"
