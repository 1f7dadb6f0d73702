"""Text functions as Column expressions with Python's white-space and token rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space; page-number patterns; common words; document types; OCR garbage.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PAGE_PATTERNS = [rf"Page{WS}+(\d+)", rf"p\.{WS}*(\d+)", r"^(\d+)$", rf"[-\x{{2212}}]{WS}*(\d+){WS}*[-\x{{2212}}]"]
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# The common words are a set: order and repeats say nothing.
COMMON_WORDS = (
    "a about all an and are as at be been but by can could did do for from get had has have he her his i if in into is it may "
    "me my not of on one only or out said say she so some than that the their them there these they this to up was we were "
    "what which who will with would you your"
).split()
DOCUMENT_TYPES = "Invoice Contract Agreement Letter Report Receipt Form Certificate Statement Memo Proposal Notice Policy Other".split()
GARBAGE_PAGES = ["|||||||", "###", "...", "---"]
GARBAGE_WORDS = ["|", "||", "|||", "#", "##", "###", "...", "---", "]", "[", "}{", "()"]
STRONG_WORDS = "reset changes new different boundary clear".split()
WEAK_WORDS = "unclear maybe possibly might uncertain".split()


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def page_number(text: Column) -> Column:
    """The first of the patterns whose first match is 1 to 9999; null if none is."""

    def one(pattern: str) -> Column:
        # Without zeros before it, a number of four digits at most is 1 to 9999; said so that the text is searched once.
        return F.ltrim(F.regexp_extract(text, "(?imd)" + pattern, 1), F.lit("0")).try_cast("decimal(4,0)")

    return F.coalesce(*map(one, PAGE_PATTERNS)).cast("int")


def header_footer(text: Column) -> tuple[Column, Column]:
    lines = F.split(text_of(text), "\n")
    two = F.size(lines) >= 2
    return tuple(F.when(two, py_strip(F.element_at(lines, k))).otherwise("") for k in (1, -1))


def blank_measure(text: Column) -> Column:
    return F.length(py_strip(text_of(text)))


def clean_text(text: Column) -> Column:
    return py_strip(F.regexp_replace(text_of(text), f"{WS}+", " "))


def make_safe_filename(text: Column) -> Column:
    out = F.regexp_replace(text, r'[<>:"/\\|?*]', "")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit("_")), "_+", "_")
    return F.substring(F.regexp_replace(out, r"\A_+|_+\z", ""), 1, 100)


def heuristic_name(text: Column, ordinal: Column, prefix: str = "document") -> Column:
    """From the first 50 characters of the cleaned page, or prefix and 1-based segment number."""
    cleaned = clean_text(text)
    safe = make_safe_filename(F.substring(cleaned, 1, 50))
    return F.when((F.length(cleaned) > 10) & (F.length(safe) > 0), safe).otherwise(numbered_name(ordinal, prefix))


def with_plain_name(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``plain_name``: what ``heuristic_name`` makes of the text, null where it takes the number. The text is cleaned once."""
    out = rows.withColumn("__clean", clean_text(F.col(text)))
    out = out.withColumn("__long", F.length("__clean") > 10).withColumn("__safe", make_safe_filename(F.substring("__clean", 1, 50)))
    return out.withColumn("plain_name", F.when(F.col("__long") & (F.length("__safe") > 0), F.col("__safe"))).drop("__clean", "__long", "__safe")


def numbered_name(ordinal: Column, prefix: str = "document") -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(ordinal.cast("string"), 4, "0"))


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters of the lower-cased text, told apart from others at letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]+$"))


def page_invalid_reason(text: Column) -> Column:
    """Why an OCR page is no valid output; null for valid ones."""
    stripped = py_strip(text_of(text))
    return (
        F.when(F.length(stripped) == 0, "empty")
        .when(F.regexp_count(text_of(text), F.lit(r"[\p{L}\p{N}]")) / F.length(text_of(text)) < F.lit(0.3), "low alphanumeric ratio")
        .when(stripped.isin(GARBAGE_PAGES), "garbage pattern")
    )


def word_valid(word: Column) -> Column:
    w = text_of(word)
    n = F.length(w)
    return (n > 0) & (F.regexp_count(w, F.lit(r"[\p{L}\p{N}]")) / F.greatest(n, F.lit(1)) >= F.lit(0.5)) & ~py_strip(w).isin(GARBAGE_WORDS) & (F.regexp_count(w, F.lit("[.,!?;:]")) < n)


def parse_decision(response: Column) -> Column:
    """``struct<should_split, reason>`` from an answer that starts with YES or NO."""
    r = py_strip(text_of(response))

    def rest(n: int) -> Column:
        tail = py_strip(F.substring(r, n + 1, 1 << 30))
        return py_strip(F.regexp_replace(tail, r"\A[-:]", ""))

    yes, no = F.upper(r).startswith("YES"), F.upper(r).startswith("NO")
    return F.struct(yes.alias("should_split"), F.when(yes, rest(3)).when(no, rest(2)).otherwise(F.concat(F.lit("Unclear response: "), r)).alias("reason"))


def decision_confidence(should_split: Column, signals: Column, reason: Column) -> Column:
    low = F.lower(reason)
    base = F.when(should_split, F.lit(0.7) + F.least(signals * F.lit(0.05), F.lit(0.2))).otherwise(F.lit(0.6) - F.least(signals * F.lit(0.03), F.lit(0.15)))
    for words, step in ((STRONG_WORDS, 0.05), (WEAK_WORDS, -0.05)):
        base = base + F.lit(step) * reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def parse_filename(response: Column) -> Column:
    out = py_strip(F.split_part(py_strip(text_of(response)), F.lit("\n"), F.lit(1)))
    out = F.regexp_replace(out, r"""\A["']+|["']+\z""", "")
    out = F.regexp_replace(out, r"(?i)\.pdf\z", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\-" + WS[1:], "")
    return py_strip(F.regexp_replace(out, f"{WS}+", " "))


def name_parts(name: Column) -> Column:
    return F.split(name, "_", 3)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda x: F.length(x) > 0)


def _date_ok(c: Column) -> Column:
    return (c == "UNDATED") | c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")


def _type_ok(c: Column) -> Column:
    return c.rlike(r"\A[\p{L}\p{N}_]+\z")


def validate_filename(name: Column) -> Column:
    p = name_parts(name)
    n = F.size(words_of(F.replace(F.get(p, F.lit(2)), F.lit("_"), F.lit(" "))))
    return F.coalesce((F.size(p) == 3) & _date_ok(F.get(p, F.lit(0))) & _type_ok(F.get(p, F.lit(1))) & n.between(2, 5), F.lit(False))


def fallback_name(prefix: str, page: Column) -> Column:
    return F.concat(F.lit(f"UNDATED_Other_{prefix} "), (page + 1).cast("string"))


def fix_filename(name: Column, page: Column, prefix: str = "document") -> Column:
    p = F.split(name, "_")
    date = F.when(_date_ok(F.get(p, F.lit(0))), F.get(p, F.lit(0))).otherwise("UNDATED")
    kind = F.when(_type_ok(F.get(p, F.lit(1))), F.get(p, F.lit(1))).otherwise("Other")
    words = words_of(F.regexp_replace(F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p), F.lit(1))), " "), r"[^\p{L}\p{N}_\-" + WS[1:], ""))
    text = F.when(F.size(words) < 2, f"{prefix} Document").otherwise(F.array_join(F.slice(words, 1, 5), " "))
    return F.when(F.size(p) < 3, fallback_name(prefix, page)).otherwise(F.concat_ws("_", date, kind, text))


def name_metadata(name: Column) -> Column:
    p = name_parts(name)
    three = F.size(p) == 3
    return F.struct(
        F.when(three, F.get(p, F.lit(0))).otherwise("UNDATED").alias("date"),
        F.when(three, F.get(p, F.lit(1))).otherwise("Other").alias("doctype"),
        F.when(three, F.get(p, F.lit(2))).otherwise(name).alias("description"),
    )


def size_format(n: Column) -> Column:
    """Base 1024, at most two decimals, B to GB."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), unit), 2)
    shown = F.regexp_replace(F.regexp_replace(value.cast("decimal(20,2)").cast("string"), r"0+\z", ""), r"\.\z", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit)))


def split_prompt(before: Column, after: Column, signals: Column, page: Column) -> Column:
    """Question for a split decision: up to 300 characters of each page around, and the signals as bullets."""

    def side(pages: Column) -> Column:
        return F.when(F.size(pages) > 0, F.array_join(F.transform(pages, lambda x: F.substring(text_of(x), 1, 300)), "\n---\n")).otherwise("(none)")

    bullets = F.array_join(F.transform(signals, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.concat(F.lit("Does a new document start at page "), (page + 1).cast("string"), F.lit("?\nSignals:\n"), bullets, F.lit("\nPages before:\n"), side(before), F.lit("\nPages from there:\n"), side(after), F.lit("\nAnswer YES or NO - reason."))


def name_of_answer(response: Column, page: Column, prefix: str = "document") -> Column:
    """The file name that a model's answer gives: parsed, and mended where it is not of the form asked for. Null or
    empty answers give the fallback name."""
    parsed = parse_filename(response)
    return F.when(F.length(parsed) == 0, fallback_name(prefix, page)).when(validate_filename(parsed), parsed).otherwise(fix_filename(parsed, page, prefix))


def naming_prompt(first: Column, second: Column) -> Column:
    more = F.when(second.isNotNull(), F.concat(F.lit("\nSecond page:\n"), F.substring(second, 1, 1000))).otherwise("")
    return F.concat(F.lit("Name this document as DATE_TYPE_DESCRIPTION.\nTypes: " + ", ".join(DOCUMENT_TYPES) + "\nFirst page:\n"), F.substring(text_of(first), 1, 2000), more)


def prompt_key(kind: str, *parts: Column) -> Column:
    """Cache key of a prompt: md5 over the parts' JSON."""
    return F.concat(F.lit(f"llm_{kind}_"), F.md5(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))))))
