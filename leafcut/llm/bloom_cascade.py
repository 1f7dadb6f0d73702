"""URL filtering with cascades of Bloom filters, in DataFrame functions only.

A rule is a host and a path; it fits a url whose host is the rule's or a subdomain of it and whose path starts with
the rule's. A url can only be fitted by a few candidate keys: a suffix of its host with as many labels as some rule
has, and a prefix of its path as long as that rule's. Over the distinct candidate keys of the whole corpus (the
universe) a cascade holds exact membership in a list: level 0 is a Bloom filter of the listed keys, level 1 one of the
universe's keys that pass level 0 without being listed, level 2 one of the listed keys that pass level 1, and so on
until nothing passes wrongly. A key's place in the list follows from the first level that it does not pass, so urls
are judged without a join. Allow and block rules have a cascade each.

A cascade takes about 1.44 log2(universe / listed) + 4 bits for each listed key, for level 0's false-positive rate is
set from both counts. A plan holds the bits of one part of the keys, by their hash; there are as many parts as it takes
to keep a part's bits near ``max_bits``. Every part judges all urls, and a url's longest key over all parts decides.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 23
UPPER_RATE = 0.5


@dataclass
class Level:
    words: list[int]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        table = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        tests = []
        for at in _positions(key, self.bits, self.hashes, self.seed):
            word = F.get(table, F.shiftright(at, 6).cast("int"))
            tests.append(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    # Halves keep the products from overflowing, which ANSI arithmetic forbids.
    a, b = F.pmod(a, F.lit(1 << 40)), F.pmod(b, F.lit(1 << 40))
    return [F.pmod(a + F.lit(k) * b, F.lit(bits)) for k in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    rate = min(UPPER_RATE, max(1e-9, rate))
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2))) if n else 1
    hashes = min(hashes, 30)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
    # A row for each 64 bits; the caller has checked how many these can be.
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64L) as int))")).alias("v")).collect()
    words = [0] * ((bits + 63) // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(words, bits, hashes, seed)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """True for listed keys, of those in the universe. Null for null."""
        out = F.lit(len(self.levels) % 2 == 1)  # what passes all levels is on the side that the last one encodes
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
        return F.when(key.isNull(), F.lit(None).cast("boolean")).otherwise(out)

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch) -> Cascade:
    """The cascade of ``listed`` over ``universe`` (non-null ``key`` each). Listed keys need not be in the universe."""
    both = listed.select("key", F.lit(True).alias("listed")).union(universe.select("key", F.lit(False)))
    keys = scratch.keep(both.groupBy("key").agg(F.max("listed").alias("listed")))
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n, total = inside.count(), keys.count()
    rate = n / (math.sqrt(2) * max(total, n, 1))
    levels: list[Level] = []
    while n:
        level = _level(inside, n, rate, len(levels))
        levels.append(level)
        wrong = scratch.keep(outside.where(level.passes(F.col("key"))))
        n = wrong.count()
        inside, outside, rate = wrong, inside, UPPER_RATE
    return Cascade(levels)


def parts_for(listed: int, total: int, max_bits: int) -> int:
    """Into how many parts keys are dealt."""
    bits = listed * (1.44 * math.log2(max(total, listed, 1) / max(listed, 1)) + 4) if listed else 0
    return max(1, math.ceil(bits / max(1, max_bits)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the keys that could fit: longest first, then in text order. ``shapes``: numbers of labels and path lengths
    that rules have; they are data of the plan, which does not grow with them."""
    given = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>")
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    parts = F.split(host, r"\.")
    fits = F.filter(given, lambda x: (x["n"] <= dots + 1) & (F.length(host) > 0) & (x["m"] <= F.length(path)))

    def key(x: Column) -> Column:
        tail = F.array_join(F.slice(parts, dots + 2 - x["n"], x["n"]), ".")
        return F.concat(tail, F.substring(path, F.lit(1), x["m"]))

    ranked = F.transform(fits, lambda x: F.struct((-F.length(key(x))).alias("l"), key(x).alias("k")))
    return F.transform(F.sort_array(F.array_distinct(ranked)), lambda x: x["k"])


def url_verdicts(pages: DataFrame, rules: DataFrame, unlisted: str = "allow", max_bits: int = MAX_BITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules``: columns ``host, path, verdict`` (allow or block); rows with a null are ignored, and of rules with equal
    host and path block wins. The longest fitting rule (its host and path together; ties in text order) decides; a
    url that no rule fits gets ``unlisted``, with a null rule. A null url, or one without ``://``, has an empty host
    and path and is fitted by no rule. A rule whose host is empty fits nothing; a path starts with ``/`` or is empty.
    Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "cascade")
    host, path = host_and_path(F.col(url_col))
    sites = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null and host != ''")
    rules = rules.select(F.concat("host", "path").alias("key"), (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("n"), F.length("path").alias("m"), (F.col("verdict") == "block").alias("block"))
    # A host and a path of different lengths can give the same key; the key is what is listed.
    rules = scratch.keep(rules.groupBy("key", "n", "m").agg(F.max("block").alias("block")))
    shapes = sorted((r["n"], r["m"]) for r in rules.select("n", "m").distinct().collect())  # as many as hosts have labels times paths have characters
    keys = candidate_keys(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>")
    universe = scratch.keep(sites.select(F.explode(keys).alias("key")).distinct())
    listed = rules.groupBy("key").agg(F.max("block").alias("block"))
    n = listed.count()
    parts = parts_for(n, universe.count(), max_bits)
    if parts > 1:
        sites = scratch.keep(sites.withColumn("row", F.monotonically_increasing_id()))
    judged = []
    for k in range(parts):
        here = lambda key: F.pmod(F.xxhash64(key), F.lit(parts)) == k if parts > 1 else F.lit(True)  # noqa: B023, E731
        own, known = universe.where(here(F.col("key"))), listed.where(here(F.col("key")))
        blocks, allows = (build_cascade(known.where(F.col("block") == b).select("key"), own, scratch) for b in (True, False))
        fit = F.transform(F.filter("keys", here) if parts > 1 else F.col("keys"), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("key"), F.when(blocks.holds(x), "block").when(allows.holds(x), "allow").alias("verdict")))  # noqa: B023
        judged.append(sites.withColumn("keys", keys).withColumn("fit", F.get(F.filter(fit, lambda x: x["verdict"].isNotNull()), F.lit(0))).drop("keys"))
    out = judged[0]
    if parts > 1:
        for more in judged[1:]:
            out = out.union(more)
        out = out.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.min("fit").alias("fit"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.key").alias("rule"), F.coalesce("fit.verdict", F.lit(unlisted)).alias("verdict"))
