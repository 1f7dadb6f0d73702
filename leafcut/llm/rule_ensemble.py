"""A quality classifier from a sparse ensemble of rules.

Boosted shallow trees are grown over text statistics of a bounded sample of labelled rows; every path from a root to a
node is a conjunction of threshold conditions. A logistic model with a lasso penalty keeps few of these rules, and the
kept ones are compiled into one Spark column expression, so scoring runs in the JVM over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
Condition = tuple[int, bool, float]  # statistic, greater than, threshold


def with_statistics(rows: DataFrame, text: str, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows and statistics of a whole text (null: empty), of its characters, words and lines: all, or
    those named. Each text is cut into words and lines once."""
    t, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    once = rows.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    once = once.select("*", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("__words"), F.array_remove(F.split(t, "\n"), "").alias("__lines"))
    chars, n_words, n_lines = (F.greatest(x, F.lit(1)) for x in (F.length(t), F.size(words), F.size(lines)))

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / chars

    def without(literal: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))

    def of_words(test) -> Column:
        return F.size(F.filter(words, test)) / n_words

    stats = {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": F.length(t) / n_words,
        "upper": share(r"\p{Lu}"),
        "symbols": share(r"[#$%&*+<=>@\\^_`|~{}\[\]]"),
        "exclamation": without("!") / chars,
        "digits": share("[0-9]"),
        "letters": F.length(F.regexp_replace(t, r"\P{L}+", "")) / chars,
        "stops": of_words(lambda w: w.endswith(".") | w.endswith("?")),
        "commas": without(",") / n_words,
        "marked_words": of_words(lambda w: w.rlike(r"[^\p{L}\p{N}]{2}\z")),
        "line_words": F.size(words) / n_lines,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / n_lines,
        "short_words": of_words(lambda w: F.length(w) <= 3),
    }
    return once.select(*columns, *(c.alias(n) for n, c in stats.items() if names is None or n in names))


NAMES = "chars words word_length upper symbols exclamation digits letters stops commas marked_words line_words repeated_lines short_words".split()


@dataclass
class RuleModel:
    names: list[str]
    rules: list[tuple[Condition, ...]]
    weights: np.ndarray
    bias: float

    def column(self, stats: dict[str, Column] | None = None) -> Column:
        """The score, from columns named like the statistics or from the given ones."""
        value = [(stats or {}).get(n, F.col(n)) for n in self.names]

        def term(rule: tuple[Condition, ...], w: float) -> Column:
            holds = reduce(lambda a, b: a & b, [(value[k] > F.lit(t)) if more else (value[k] <= F.lit(t)) for k, more, t in rule])
            return F.when(holds, F.lit(w)).otherwise(F.lit(0.0))

        terms = [F.lit(float(self.bias)), *(term(r, float(w)) for r, w in zip(self.rules, self.weights, strict=True))]
        while len(terms) > 1:  # a balanced tree, for deep ones overflow the planner's stack
            terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rule_matrix(x, self.rules) @ self.weights + self.bias)))


def rule_matrix(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for k, more, t in rule:
            out[:, j] *= (x[:, k] > t) if more else (x[:, k] <= t)
    return out


def _tree(x: np.ndarray, target: np.ndarray, rows: np.ndarray, columns: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, least: int, fitted: np.ndarray, rules: list) -> None:
    """Grow one regression tree of ``target``; adds the path of every node to ``rules`` and leaf means to ``fitted``."""
    best = (1e-12, None)
    total, n = target[rows].sum(), len(rows)
    if depth and n >= 2 * least:
        for k in columns:
            at = np.searchsorted(cuts[k], x[rows, k], "left")  # bin b: at most cut b
            count = np.cumsum(np.bincount(at, minlength=len(cuts[k]) + 1))[:-1]
            sums = np.cumsum(np.bincount(at, weights=target[rows], minlength=len(cuts[k]) + 1))[:-1]
            good = (count >= least) & (n - count >= least)
            if good.any():
                gain = np.where(good, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], (int(k), float(cuts[k][b])))
    if best[1] is None:
        fitted[rows] = total / max(n, 1)
        return
    k, t = best[1]
    for more in (False, True):
        part = rows[(x[rows, k] > t) == more]
        own = (*path, (k, more, t))
        rules.append(own)
        _tree(x, target, part, columns, cuts, depth - 1, own, least, fitted, rules)


def _simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Of several conditions on the same side of a statistic, the strictest."""
    least: dict[tuple[int, bool], float] = {}
    for k, more, t in rule:
        least[k, more] = max(least.get((k, more), t), t) if more else min(least.get((k, more), t), t)
    return tuple(sorted((k, more, t) for (k, more), t in least.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    """Boosted trees give the candidate rules; a lasso-penalised logistic regression weighs them."""
    rng = np.random.default_rng(seed)
    n = len(y)
    base = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    if not n or y.min() == y.max():
        return RuleModel(names, [], np.zeros(0), bias)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    score, found = np.full(n, bias), {}
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(n) < 0.5)
        columns = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        p = 1 / (1 + np.exp(-score))
        rules: list = []
        fitted = np.zeros(n)
        _tree(x, y - p, rows, columns, cuts, depth, (), max(5, n // 500), fitted, rules)
        for r in rules:
            found[_simplified(r)] = None
        # Rows left out of the sample take no step; boosting is only the search for rules.
        score += 2.0 * fitted
    rules = list(found)
    m = rule_matrix(x, rules)
    spread = m.std(0)
    keep = spread > 1e-3
    rules, m = [r for r, k in zip(rules, keep, strict=True) if k], m[:, keep]
    # Accelerated proximal gradient; a rule's column is scaled by its spread.
    scale = m.std(0)
    z = (m - m.mean(0)) / scale
    w, b, v, t = np.zeros(z.shape[1]), bias, np.zeros(z.shape[1]), 1.0
    top = np.linalg.norm(z[:, :], 2) ** 2 / n if z.size else 1.0
    step = 1 / (0.25 * top + 1e-9)
    for _ in range(400):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        g = z.T @ (p - y) / n
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    used = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[used] / scale[used]
    return RuleModel(names, [rules[k] for k in used], weights, float(b - (m.mean(0)[used] * weights).sum()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``id, text, label`` of at most ``rows`` labelled documents, those with the least hash of their identifier."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(rows)
    # The sample's size is a parameter, so it can be broadcast. Of rows that share an identifier one is taken.
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"), F.first("label").alias("label")).select("id", "t.text", "label")


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, RuleModel]:
    """Scores of every row, ``doc_id, score, predicted``, and the model.

    ``train``: of rows of ``labels``, which may be learned from; at most ``sample_rows`` are. Repeated labels of an
    identifier count as the greatest. Null texts count as empty; rows with null or repeated identifiers are scored
    like any other. Without labels of both kinds the score is the share of label 1, or 0.5. Empty tables give empty
    results; other columns are ignored.
    """
    sample = labelled_sample(docs, labels.where(train), label_col, id_col, text_col, sample_rows)
    got = with_statistics(sample, "text", ["label"]).toPandas()  # at most sample_rows rows
    x, y = got[NAMES].to_numpy(dtype=float), got["label"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # rows come in any order; the model must not depend on it
    model = fit_rules(x[order], (y[order] > 0).astype(float), NAMES)
    used = {model.names[k] for r in model.rules for k, _, _ in r}
    # The identifier travels under a name of its own, for it may be called like a statistic.
    measured = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", ["__id"], [n for n in NAMES if n in used])
    scored = measured.select(F.col("__id").alias(id_col), model.column().alias("score"))
    return scored.select(id_col, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")), model
