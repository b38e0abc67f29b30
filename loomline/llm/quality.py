"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of each text are columns. On a bounded sample of labelled rows small trees are
boosted over them; every path from a root becomes a conjunctive rule; a lasso logistic
regression weighs rules and statistics, and those of weight other than 0 are compiled into
one column expression that scores all texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, fresh, table

SPACE = r"[ \t\n\x0B\f\r]+"
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "marks", "symbols", "shouts", "bars",
    "distinct", "repeats", "lines", "repeated_lines", "longest",
)


def free_prefix(docs: DataFrame, prefix: str = "_s_") -> str:
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_s_") -> DataFrame:
    """Rows of `docs` with the STATISTICS, doubles named with the prefix, added.

    Null counts as empty; an empty text has statistics of 0. Lengths are in characters,
    shares are of characters, words or lines of the whole text. A column of `docs` that begins
    with the prefix is an error; free_prefix() gives one that none begins with.
    """
    if any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        raise ValueError(f"columns begin with {prefix}; give another prefix")
    t = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.regexp_replace(t, rf"^{SPACE}|{SPACE}$", "")
    t_, w_, l_ = (fresh(docs, f"{prefix}_{x}") for x in "twl")
    raw = docs.withColumn(t_, t).withColumn(w_, F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")))
    raw = raw.withColumn(l_, F.split(t_, "\n"))
    n, k, lines = F.length(t_).cast("double"), F.size(w_).cast("double"), F.size(l_).cast("double")
    per = lambda x, of: x.cast("double") / F.greatest(of, F.lit(1.0))
    w, count = F.col(w_), lambda p: F.regexp_count(t_, F.lit(p))
    value = {
        "log_chars": F.log1p(n),
        "log_words": F.log1p(k),
        "word_length": per(n, k),
        "upper": per(count(r"\p{Lu}"), n),
        "digits": per(count(r"[0-9]"), n),
        "marks": per(count(r"[.,;:?!]"), k),
        "symbols": per(count(r"[%*&$#@^~_=+<>{}\[\]\\/|]"), n),
        "shouts": per(count("!"), k),
        "bars": per(count(r"\|"), k),
        "distinct": per(F.size(F.array_distinct(w)), k),
        "repeats": per(F.size(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda x: x["a"] == x["b"])), k),
        "lines": per(lines, k),
        "repeated_lines": F.lit(1.0) - per(F.size(F.array_distinct(l_)), lines),
        "longest": F.log1p(F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("double")),
    }
    return raw.select(*[F.col(c) for c in docs.columns], *[value[s].alias(prefix + s) for s in STATISTICS])


class Rule:
    """A conjunction of (statistic, is greater, threshold) conditions."""

    __slots__ = ("conditions",)

    def __init__(self, conditions: Sequence[tuple[int, bool, float]]):
        narrowed: dict[tuple[int, bool], float] = {}
        for f, greater, at in conditions:
            old = narrowed.get((f, greater))
            narrowed[f, greater] = at if old is None else max(old, at) if greater else min(old, at)
        self.conditions = tuple(sorted((f, g, at) for (f, g), at in narrowed.items()))

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, f] > at) if greater else (x[:, f] <= at) for f, greater, at in self.conditions])

    def column(self, prefix: str) -> Column:
        each = [(F.col(prefix + STATISTICS[f]) > at) if greater else (F.col(prefix + STATISTICS[f]) <= at) for f, greater, at in self.conditions]
        return reduce(lambda a, b: a & b, each)


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, bins: int = 48, least: int = 10):
    """A regression tree on gradients: its paths as rules, and its prediction."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    rules: list[Rule] = []
    value = np.zeros(len(x))

    def split(rows: np.ndarray, path: list, left: int):
        if path:
            rules.append(Rule(path))
        g, h = gradient[rows], hessian[rows]
        value[rows] = -g.sum() / (h.sum() + 1)
        if not left or len(rows) < 2 * least:
            return
        best = (1e-6, None, 0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            c = code[f][rows]
            gs, hs, ns = (np.cumsum(np.bincount(c, weights=v, minlength=len(e) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return
        at, below = float(edges[f][k]), code[f][rows] <= k
        split(rows[below], [*path, (f, False, at)], left - 1)
        split(rows[~below], [*path, (f, True, at)], left - 1)

    split(np.arange(len(x)), [], depth)
    return rules, value


class RuleEnsemble:
    """Rules and scaled statistics with lasso logistic weights."""

    def __init__(self):
        self.rules: list[Rule] = []
        self.weights: np.ndarray = np.zeros(0)
        self.linear: list[tuple[int, float, float, float]] = []  # statistic, low, high, weight
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 2e-3, steps: int = 400):
        n = len(y)
        prior = (y.sum() + 0.5) / (n + 1)
        self.bias = float(np.log(prior / (1 - prior)))
        if n == 0 or y.min() == y.max():
            return self
        found: dict[tuple, Rule] = {}
        f = np.full(n, self.bias)
        rng = np.random.default_rng(3)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            part = rng.random(n) < 0.7
            rules, _ = grow(x[part], (p - y)[part], (p * (1 - p))[part], depth)
            if not rules:
                break
            for r in rules:
                found.setdefault(r.conditions, r)
            leaves = np.zeros(n)
            deepest = [r for r in rules if not any(set(r.conditions) < set(o.conditions) for o in rules)]
            for r in deepest:
                own = r.holds(x)
                leaves[own] = -(p - y)[own].sum() / ((p * (1 - p))[own].sum() + 1)
            f = np.clip(f + rate * leaves, -12, 12)
        rules = [r for r in found.values() if 0.002 < r.holds(x).mean() < 0.998]
        low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
        wide = [k for k in range(x.shape[1]) if high[k] > low[k]]
        a = np.column_stack([*[r.holds(x).astype(float) for r in rules], *[0.4 * (np.clip(x[:, k], low[k], high[k]) - low[k]) / (high[k] - low[k]) for k in wide]])
        w, b = _lasso_logistic(a, y, penalty, steps, self.bias)
        m = len(rules)
        kept = np.flatnonzero(w[:m])
        self.rules, self.weights = [rules[k] for k in kept], w[kept]
        self.linear = [(k, float(low[k]), float(high[k]), float(0.4 * v)) for k, v in zip(wide, w[m:], strict=True) if v]
        self.bias = b
        return self

    def column(self, prefix: str = "_s_") -> Column:
        """The score, from 0 to 1, over statistics named with the prefix."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(prefix), F.lit(float(w))).otherwise(F.lit(0.0))
        for k, low, high, w in self.linear:
            s = F.least(F.greatest(F.col(prefix + STATISTICS[k]), F.lit(low)), F.lit(high))
            z = z + (s - F.lit(low)) * F.lit(w / (high - low))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        for k, low, high, w in self.linear:
            z += w * (np.clip(x[:, k], low, high) - low) / (high - low)
        return 1 / (1 + np.exp(-z))


def _lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int, bias: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient descent on log loss + penalty * |w|; b has no penalty."""
    n, m = a.shape
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(m), bias, np.zeros(m), bias, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y) / n
        new = v - step * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, t_new = c - step * r.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, modulus: int | None = 4, left_out: int = 2) -> RuleEnsemble:
    """Fit on at most max_rows labelled rows, those of the least hash of the id.

    Rows whose crc32(doc_id) mod `modulus` is left_out are never used; None uses all.
    Null labels and ids without a document are left out. With no label, or only one, the
    score is a constant.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    if modulus:
        known = known.where(doc_fold(F.col("doc_id"), modulus) != left_out)
    sample = known.select("doc_id", (F.col(label_col) > 0).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).drop("text")
    got = sorted(tuple(r) for r in rows.collect())  # at most max_rows of a few numbers
    x = np.array([r[2:] for r in got], float).reshape(-1, len(STATISTICS))
    return RuleEnsemble().fit(x, np.array([r[1] for r in got], float))


def quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Rows of `docs` with out_col (0 to 1, higher is better) added, or in its place.

    Null and empty texts are scored by their statistics, which are 0. Repeated rows get
    equal scores; an empty table gives no rows; columns of other names pass unchanged.
    """
    keep, prefix = [c for c in docs.columns if c != out_col], free_prefix(docs)
    return statistics(docs, text_col, prefix).select(*[F.col(c) for c in keep], model.column(prefix).alias(out_col))


def op1_quality(spark, sf_dir):
    """Quality of every text of `documents`; edge cases as quality() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model, out_col="score").select(
        "doc_id",
        (doc_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
