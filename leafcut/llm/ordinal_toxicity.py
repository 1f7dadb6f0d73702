"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 < ...; the expected
severity is the sum of these probabilities. Features are log(1 + count) of selected words and word beginnings of
``PREFIXES`` characters: A-Z lower-cased, ASCII punctuation taken as white space. They are those whose presence in the
sampled labelled documents says most about the label, and more than chance says of as many features. Where labels only mark toxic documents, grades above 0 follow from how many words of a marked document speak
for the mark: the sample's quantiles cut them into ``grades`` - 1 grades.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcut.llm.rule_ensemble import labelled_sample
from leafcut.llm.shared import Scratch, each_text, partitions, text_bytes, tidy

SAMPLE_ROWS = 12_000
FEATURES = 256
PREFIXES = (3, 4, 5, 6, 7, 8)
CACHE_WORDS = 150_000
FALSE_SHARE = 0.05
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def features_of(word: bytes) -> list[bytes]:
    """The word, and what it goes on from, marked by ``^``: a stem in a longer word need not mean what it means alone."""
    t = word.decode(errors="replace")
    return [word, *(b"^" + t[:k].encode() for k in PREFIXES if len(t) >= k)]


@dataclass
class OrdinalModel:
    features: list[bytes]
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: Iterable[bytes]) -> list[tuple[float, float, int]]:
        """P(grade >= 1), expected severity and most likely grade of each text."""
        number = {f: k for k, f in enumerate(self.features)}
        seen: dict[bytes, tuple[int, ...] | None] = self.__dict__.setdefault("_seen", {})
        out = []
        for t in texts:
            count = Counter(t.translate(_FOLD).split())
            found: Counter[int] = Counter()
            for w in [w for w in count if w not in seen]:
                seen[w] = tuple(number[f] for f in features_of(w) if f in number) or None
            for w, n in count.items():
                if own := seen[w]:
                    for k in own:
                        found[k] += n
            if len(seen) > CACHE_WORDS:
                seen.clear()
            score = sum(self.weights[k] * math.log1p(n) for k, n in sorted(found.items()))
            above = [1 / (1 + math.exp(min(700.0, max(-700.0, x - score)))) for x in self.thresholds]
            each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
            out.append((above[0], sum(above), max(range(len(each)), key=each.__getitem__)))
        return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l2: float = 1e-5, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the negative log-likelihood; thresholds stay ordered."""
    n, d = x.shape
    w = np.zeros(d)
    share = np.array([np.clip((grade >= k).mean() if n else 0.5, 1e-3, 1 - 1e-3) for k in range(1, grades)])
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    raw = np.r_[t[0], np.log(np.maximum(np.diff(t), 1e-3))]
    # Documents alike count once, with their number; most have no feature at all.
    rows, times = np.unique(np.c_[x, grade], axis=0, return_counts=True)
    x, grade, times = np.ascontiguousarray(rows[:, :d]), rows[:, d].astype(int), times.astype(float)
    every = np.arange(len(x))
    m, v = np.zeros(d + grades - 1), np.zeros(d + grades - 1)
    for step in range(1, steps + 1) if n else ():
        gap = np.exp(raw[1:])
        t = raw[0] + np.r_[0, np.cumsum(gap)]
        s = x @ w
        edge = np.c_[np.ones(len(x)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40))), np.zeros(len(x))]
        p = np.maximum(edge[every, grade] - edge[every, grade + 1], 1e-9)
        slope = edge * (1 - edge)
        up, down = times * slope[every, grade] / p, times * slope[every, grade + 1] / p
        g_w = -(x.T @ (up - down)) / n + l2 * w
        g_t = np.array([(up[grade == k].sum() - down[grade == k - 1].sum()) / n for k in range(1, grades)])
        g = np.r_[g_w, g_t.sum(), [gap[j] * g_t[j + 1 :].sum() for j in range(grades - 2)]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:d], raw - move[d:]
    return w, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]


def _strength(k: Column, n: Column, share: float) -> Column:
    """The signed root of twice the log-likelihood ratio of ``k`` marked of ``n`` against the share of all: about normal."""
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * F.lit(p)))).otherwise(0.0)
    g = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(k, share) + part(n - k, 1 - share))))
    return F.when(k >= n * F.lit(share), g).otherwise(-g)


def _least_strength(features: DataFrame) -> float:
    """The least strength from which at most ``FALSE_SHARE`` of the features are as strong by chance, whatever their number."""
    bins = features.groupBy(F.floor(F.abs("z") * 10).alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").desc()).collect()  # a row for each tenth
    total, above, least = sum(r["n"] for r in bins), 0, math.inf
    for r in bins:
        above += r["n"]
        if total * math.erfc(r["b"] / 10 / math.sqrt(2)) <= FALSE_SHARE * above:
            least = r["b"] / 10
    return least


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", grades: int = 3, graded: bool = False, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Learn from at most ``sample_rows`` labelled documents. ``graded``: labels are grades 0 to ``grades`` - 1 themselves."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows)
    sample = scratch.keep(sample.select("label", text_bytes("text").alias("t"))).repartition(partitions(docs.sparkSession))
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        w, t = fit_ordinal(np.zeros((n, 0)), np.full(n, grades - 1 if n_toxic else 0), grades)
        return OrdinalModel([], w, t)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        tox: Counter[bytes] = Counter()
        seen: dict[bytes, list[bytes]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64()), pa.array([tox[f] for f in df], pa.int64())], ["feature", "df", "tox"])

        for b in batches:
            for label, t in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
                words = set(t.translate(_FOLD).split())
                for w in [w for w in words if w not in seen]:
                    seen[w] = features_of(w)
                own = set().union(*map(seen.__getitem__, words))
                df.update(own)
                if label > 0:
                    tox.update(own)
                if len(df) > CACHE_WORDS:
                    yield out()
                    df.clear()
                    tox.clear()
                    seen.clear()
        if df:
            yield out()

    df = sample.mapInArrow(tidy(presence), "feature binary, df long, tox long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("tox").alias("tox"))
    df = scratch.keep(df.where("df >= 3").withColumn("z", _strength(F.col("tox"), F.col("df"), n_toxic / n)))
    chosen = df.where(F.abs("z") >= _least_strength(df)).orderBy(F.abs("z").desc(), "feature").limit(features)
    words = sorted((bytes(r["feature"]), r["z"]) for r in chosen.collect())
    at = {w: k for k, (w, _) in enumerate(words)}
    marks = np.array([z > 0 for _, z in words], bool)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, hits, seen = [], [], {}
            for t in each_text(b.column(1)):
                count, found = Counter(t.translate(_FOLD).split()), Counter()
                for w in [w for w in count if w not in seen]:
                    seen[w] = [at[f] for f in features_of(w) if f in at]
                for w, k in count.items():
                    for f in seen[w]:
                        found[f] += k
                own.append(found)
                hits.append(sum(k for w, k in count.items() if any(marks[f] for f in seen[w])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.int64()), pa.array([list(x) for x in own], pa.list_(pa.int64())), pa.array([list(x.values()) for x in own], pa.list_(pa.int64()))], ["label", "hits", "at", "times"])

    picked = sample.mapInArrow(tidy(pick), "label double, hits long, at array<long>, times array<long>").collect()  # sample_rows rows of at most ``features`` numbers
    x = np.zeros((len(picked), len(words)))
    for i, r in enumerate(picked):
        x[i, r["at"]] = r["times"]
    label, hits = np.array([r["label"] for r in picked]), np.array([r["hits"] for r in picked])
    order = np.lexsort((*x.T[:8], hits, label))
    x, label, hits = x[order], label[order], hits[order]
    if graded:
        grade = np.clip(label, 0, grades - 1).astype(int)
    else:
        cuts = np.quantile(hits[label > 0], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(label > 0, 1 + np.searchsorted(cuts, hits, "left"), 0)
    w, t = fit_ordinal(np.log1p(x), grade, grades)
    used = np.flatnonzero(np.abs(w) > 1e-3)
    return OrdinalModel([words[k][0] for k in used], w[used], t)


def toxicity_scores(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_toxic, expected_severity, grade, toxic`` of every row.

    ``toxic``: P(grade >= 1) is ``threshold`` or more. Null text counts as empty; rows with null or repeated
    identifiers are scored like any other. A model without labels of both kinds gives all texts one score. An empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.scores(each_text(b.column(1)))
            p, severity, grade = (list(c) for c in zip(*got, strict=True)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array([x >= threshold for x in p], pa.bool_())], ["id", "p_toxic", "expected_severity", "grade", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(tidy(run), "id long, p_toxic double, expected_severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([p < threshold for p, *_ in model.scores(each_text(b.column(k)))], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
