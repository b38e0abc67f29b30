"""Licence scans: a trained paragraph classifier, on DataFrame functions only.

A multinomial logistic regression over the presence of word n-grams, sparse by a lasso,
is learned from notices of each family, licence-like paragraphs of no family ("unknown")
and ordinary ones ("none"); its probabilities are calibrated by a temperature on the
variants held out. A predicted family must be confirmed by the share of one of its
templates' word pairs that the paragraph holds. Every paragraph is scored, none is left
out for the words it lacks. Scoring is a column expression: it runs without a shuffle.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_templates import HELD_WORDINGS, NAMES, OTHER, TEMPLATES, UNKNOWN, WORDINGS

WORD = r"[a-z0-9]+"
#: Words too common to be features by themselves.
#: "mit" is one too, in German; its pairs are features.
COMMON = frozenset("a all an and any are as at be by can for form found from has have he in is it no not of on or our part see she that the their this to under use used was we were which with you your was who work".split())
CLASSES = (*TEMPLATES, "unknown", "none")


def grams(words: list[str]) -> set[str]:
    """Single words that are not common, and pairs of adjacent words."""
    return {w for w in words if w not in COMMON and w != "mit" and len(w) > 1} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in COMMON and b in COMMON)}


def tokens(paragraph: str) -> list[str]:
    return re.findall(WORD, paragraph.lower())


def notices(family: str, wordings) -> list[str]:
    """The family's names in these wordings."""
    return [x.format(name) for name in NAMES.get(family, []) for x in wordings]


class Model:
    """Weights by gram and class, biases, temperature, template word pairs, and triggers.

    Names in wordings that aren't fitted, and a share of each text's variants, are held out;
    they set the temperature. A text without a trigger is certain to be ordinary.
    """

    def __init__(self, penalty: float = 6e-4, steps: int = 400, threshold: float = 0.5, similarity: float = 0.5, seed: int = 5):
        self.threshold, self.similarity = threshold, similarity
        rng = np.random.default_rng(seed)
        fit, held = [], []
        for k, c in enumerate(CLASSES):
            for text in TEMPLATES.get(c, UNKNOWN if c == "unknown" else OTHER):
                for v, words in enumerate(_variants(tokens(text), rng)):
                    (held if v % 4 == 3 else fit).append((grams(words), k))
            for text in notices(c, WORDINGS):
                fit += [(grams(words), k) for words in _variants(tokens(text), rng)[:2]]
            held += [(grams(tokens(text)), k) for text in notices(c, HELD_WORDINGS)]
        names = sorted({g for x, _ in fit for g in x})
        at = {g: i for i, g in enumerate(names)}
        x, y = _matrix(fit, at)
        w = _lasso_softmax(x, y, len(CLASSES), penalty, steps)
        used = np.flatnonzero(np.abs(w[:-1]).sum(1) > 1e-6)
        self.grams = [names[i] for i in used]
        self.weights, self.bias = w[used], w[-1]
        xh, yh = _matrix(held, {g: i for i, g in enumerate(self.grams)})
        z = xh @ np.vstack([self.weights, self.bias])
        self.temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean())
        own = {c: [*v, *notices(c, WORDINGS)] for c, v in TEMPLATES.items()}
        self.templates = {c: sorted({tuple(sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)})) for t in map(tokens, v)} - {()}) for c, v in own.items()}
        self.longest = max(len(tokens(t)) for v in own.values() for t in v)
        self.triggers = self._triggers()

    def _triggers(self) -> list[str]:
        """Words of which a text must hold one for anything but "none" to come out.

        A text without one has only grams that lift no class above "none", all of them
        together; and it holds less of each template than a family needs to be confirmed.
        """
        often = Counter(w for t in OTHER for w in set(tokens(t)))
        often.update(dict.fromkeys((*COMMON, "mit"), 100))

        def rare(gram):  # its word that ordinary text seldom holds
            return min(gram.split(), key=lambda w: (often[w], len(w) < 4, -len(w), w))

        none = CLASSES.index("none")
        room = self.bias[none] - np.delete(self.bias, none)
        if (room <= 0).any():
            raise ValueError("a text without any feature must be ordinary")
        lift = {g: np.maximum(np.delete(w, none) - w[none], 0) for g, w in zip(self.grams, self.weights, strict=True)}
        own: dict[str, list[np.ndarray]] = {}
        for g, x in lift.items():
            own.setdefault(rare(g), []).append(x)
        spent = np.zeros_like(room)
        out = set()
        for w in sorted(own, key=lambda w: (-often[w], sum(x.max() for x in own[w]), w)):
            with_it = spent + np.sum(own[w], axis=0)
            if (with_it < 0.99 * room).all():
                spent = with_it  # even all of these grams at once don't lift a class above "none"
            else:
                out.add(w)
        for templates in self.templates.values():
            for pairs in templates:  # half of them is asked for: more than half must be without triggers
                need = int(np.ceil(self.similarity * len(pairs)))
                words = sorted((rare(p) for p in pairs), key=lambda w: (w not in out, often[w], -len(w), w))
                out.update(words[: len(pairs) - need + 1])
        return sorted(out)


@functools.cache
def default_model() -> Model:
    """The model of the notices in license_templates; fitted once a session."""
    return Model()


def alternatives(words: list[str]) -> str:
    """A pattern for any of the words, as a tree of their letters: each is read once."""
    if words == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [c + alternatives(sorted(rest)) for c, rest in sorted(by.items())]
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or "" in words else parts[0]) + ("?" if "" in words else "")


def _variants(words: list[str], rng) -> list[list[str]]:
    """The text itself, and with words around it, lost or cut off."""
    around = "the house was here and then some of them came with more than that in spring".split()
    out = [words]
    for k in range(11):
        v = [w for w in words if k % 3 or rng.random() > 0.12]
        if k % 3 == 1:
            v = [str(x) for x in rng.choice(around, rng.integers(1, 6))] + v + [str(x) for x in rng.choice(around, rng.integers(0, 6))]
        if k % 3 == 2 and len(v) > 8:
            v = v[: max(6, int(len(v) * 0.7))]
        out.append(v)
    return out


def _matrix(rows, at):
    x = np.zeros((len(rows), len(at) + 1), np.float32)
    x[:, -1] = 1
    for i, (own, _) in enumerate(rows):
        for g in own:
            if g in at:
                x[i, at[g]] = 1
    return x, np.array([k for _, k in rows])


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lasso_softmax(x, y, classes, penalty, steps):
    """Accelerated proximal gradient descent; biases have no penalty."""
    target = np.eye(classes, dtype=np.float32)[y]
    own = (1 / np.bincount(y, minlength=classes)[y] / classes).astype(np.float32)  # classes weigh the same
    step = 2 / np.linalg.norm(x * np.sqrt(own)[:, None], 2) ** 2
    w = v = np.zeros((x.shape[1], classes), np.float32)
    t = 1.0
    for _ in range(steps):
        new = v - step * (x.T @ ((_softmax(x @ v) - target) * own[:, None]))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty / 4, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def _literal(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def license_scan(docs: DataFrame, text_col: str = "text", out_col: str = "licences", model: Model | None = None) -> DataFrame:
    """Rows of `docs` with out_col added, or in its place: the licence paragraphs of each.

    An array of struct(paragraph: its first line's place among the text's lines, from 0; family;
    probability; similarity to the family's best template; text). family is "unknown" for
    a paragraph that is licence-like but whose family is not probable enough or not
    confirmed by a template. Each line is classified by itself, and with the lines after it up
    to an empty one (without letters or digits), so that wrapped notices are seen whole; of
    lines together only confirmed families count, and take the place of lines that are a
    part of them. Whole texts are scanned. Null and empty
    texts have none; repeated rows get equal results; an empty table gives no rows.
    """
    m = model or default_model()
    text = F.col(text_col)
    scale = 1 / m.temperature
    # The model's tables as literals that are parsed once, when the plan is made.
    weights = _literal({g: [float(x) * scale for x in w] for g, w in zip(m.grams, m.weights, strict=True)}, "map<string,array<double>>")
    known = _literal(m.grams, "array<string>")
    bias = _literal([float(b) * scale for b in m.bias], "array<double>")
    families, n = _literal(CLASSES, "array<string>"), len(CLASSES)
    none = CLASSES.index("none") + 1
    pairs = _literal([m.templates.get(c, [[]]) for c in CLASSES], "array<array<array<string>>>")

    def adjacent(w):
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))

    def judge(i, t, words):  # each step in a transform of its own, so that none is evaluated again for every word
        with_grams = F.transform(F.transform(F.array(words), lambda w: F.struct(w.alias("w"), adjacent(w).alias("p"))), _score)
        return F.element_at(F.transform(F.transform(with_grams, lambda s: F.struct(i.alias("i"), t.alias("t"), s["p"].alias("p"), s["z"].alias("z"))), decide), 1)

    def _score(s):
        held = F.array_intersect(known, F.concat(s["w"], s["p"]))
        z = F.aggregate(held, bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
        return F.struct(s["p"].alias("p"), z.alias("z"))

    def decide(s):
        top = F.array_max(s["z"])
        k = F.array_position(s["z"], top).cast("int")
        total = F.aggregate(s["z"], F.lit(0.0), lambda a, b: a + F.exp(b - top))
        held = F.transform(F.element_at(pairs, k), lambda t: F.struct((F.size(F.array_intersect(t, s["p"])) / F.greatest(F.size(t), F.lit(1))).alias("share"), t.alias("pairs")))
        return F.struct(s["i"].alias("i"), k.alias("k"), (1 / total).alias("probability"), _best(held).alias("best"), s["t"].alias("text"), s["p"].alias("p"))

    def _best(held):  # the best share, and the word pairs of all templates that the words confirm
        return F.struct(F.array_max(F.transform(held, lambda t: t["share"])).alias("share"), F.flatten(F.transform(F.filter(held, lambda t: t["share"] >= m.similarity), lambda t: t["pairs"])).alias("pairs"))

    def confirmed(s):
        return (s["k"] <= n - 2) & (s["probability"] >= m.threshold) & (s["best"]["share"] >= m.similarity)

    def name(s):
        family = F.when(confirmed(s), F.element_at(families, s["k"])).otherwise(F.lit("unknown"))
        return F.struct(s["i"].alias("paragraph"), family.alias("family"), s["probability"].alias("probability"), F.round(s["best"]["share"], 6).alias("similarity"), s["text"].alias("text"))

    # A window: a line and those after it, to the paragraph's end or until they hold as many
    # words as the longest template, so that each wrapped notice lies whole in the window of its
    # first line.
    longest = m.longest

    def reach(after, start):
        """How many of the lines `after` follow in the paragraph until the words suffice."""

        def take(acc, y):
            more = acc["open"] & (F.size(y["w"]) > 0) & (acc["n"] < longest)
            return F.struct((acc["k"] + more.cast("int")).alias("k"), (acc["n"] + F.size(y["w"])).alias("n"), more.alias("open"))

        return F.aggregate(after, F.struct(F.lit(0).alias("k"), start.alias("n"), F.lit(True).alias("open")), take)["k"]

    def starts(lines, h):  # of the windows that may hold the line h: fewer words than the longest before it
        before = F.reverse(F.slice(lines, F.greatest(h["i"] + 1 - longest, F.lit(1)), F.least(h["i"], F.lit(longest))))
        return F.transform(F.array(reach(before, F.lit(0))), lambda k: F.sequence(h["i"] - k, h["i"]))

    def window(lines, i):
        first = F.element_at(lines, i + 1)
        k = 1 + F.when(F.size(first["w"]) > 0, reach(F.slice(lines, i + 2, longest), F.lit(0))).otherwise(F.lit(0))
        return F.transform(F.array(k), lambda k: F.slice(lines, i + 1, k))

    def joined(ys):
        return judge(F.element_at(ys, 1)["i"], F.array_join(F.transform(ys, lambda y: y["t"]), "\n"), F.flatten(F.transform(ys, lambda y: y["w"])))

    def with_windows(lines):
        hot = F.filter(lines, lambda x: x["hot"])
        single = F.filter(F.transform(hot, lambda x: judge(x["i"], x["t"], x["w"])), lambda s: s["k"] != none)
        near = F.array_distinct(F.flatten(F.flatten(F.transform(hot, lambda h: starts(lines, h)))))
        groups = F.filter(F.flatten(F.transform(near, lambda i: window(lines, i))), lambda ys: (F.size(ys) > 1) & F.exists(ys, lambda y: y["hot"]))
        wrapped = F.filter(F.transform(groups, joined), confirmed)
        return F.transform(F.array(F.struct(single.alias("single"), wrapped.alias("wrapped"))), chosen)

    def end(s):
        return s["i"] + F.size(F.split(s["text"], "\n"))

    def chosen(b):
        def overlap(x, y):
            return (x["i"] < end(y)) & (y["i"] < end(x))

        def better(x, y):  # of a family's windows over the same notice the best, and of those the last to start
            return (y["best"]["share"] > x["best"]["share"]) | ((y["best"]["share"] == x["best"]["share"]) & (y["i"] > x["i"]))

        def fragment(x, y):  # most of what speaks for x is part of y's templates
            own = F.when(confirmed(x), F.array_intersect(x["best"]["pairs"], x["p"])).otherwise(x["p"])
            return (y["best"]["share"] > F.when(confirmed(x), x["best"]["share"]).otherwise(0.0)) & (2 * F.size(F.array_intersect(own, y["best"]["pairs"])) >= F.size(F.array_distinct(own)))

        new = F.filter(b["wrapped"], lambda x: ~F.exists(b["single"], lambda y: confirmed(y) & overlap(x, y) & (x["k"] == y["k"])))
        kept = F.filter(new, lambda x: ~F.exists(new, lambda y: overlap(x, y) & F.when(x["k"] == y["k"], better(x, y)).otherwise(fragment(x, y))))
        lone = F.filter(b["single"], lambda x: ~F.exists(b["wrapped"], lambda y: overlap(x, y) & fragment(x, y) & ~(confirmed(x) & (x["k"] == y["k"]))))
        return F.array_sort(F.transform(F.concat(lone, kept), name))

    # Lines, and windows, without a trigger need no scoring: they are certain to be ordinary.
    trigger = F.lit("(?<![a-z0-9])" + alternatives(m.triggers) + "(?![a-z0-9])")
    low = F.transform(F.split(text, "\n"), lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.lower(t).alias("l")))
    lines = F.transform(low, lambda x: F.struct(x["i"], x["t"], F.regexp_extract_all(x["l"], F.lit(WORD), F.lit(0)).alias("w"), F.rlike(x["l"], trigger).alias("hot")))
    named = F.element_at(F.flatten(F.transform(F.array(lines), with_windows)), 1)
    kind = "array<struct<paragraph:int,family:string,probability:double,similarity:double,text:string>>"
    named = F.when(F.rlike(F.lower(text), trigger), named)
    return docs.withColumn(out_col, F.coalesce(named, F.array().cast(kind)).cast(kind))


def classify(paragraph: str, m: Model) -> tuple[str, float, float] | None:
    """The same decision for one paragraph, in Python: the tests' brute force."""
    words = tokens(paragraph)
    own, pairs = grams(words) | set(words), {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    z = m.bias / m.temperature + sum((w / m.temperature for g, w in zip(m.grams, m.weights, strict=True) if g in own or g in pairs), np.zeros(len(CLASSES)))
    k = int(z.argmax())
    if CLASSES[k] == "none":
        return None
    p = float(1 / np.exp(z - z.max()).sum())
    similar = max((len(set(t) & pairs) / max(1, len(t)) for t in m.templates.get(CLASSES[k], [])), default=0.0)
    sure = CLASSES[k] != "unknown" and p >= m.threshold and similar >= m.similarity
    return CLASSES[k] if sure else "unknown", p, similar


def op5_license_scan(spark, sf_dir):
    """Licence notices in `documents`; edge cases as license_scan() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    each = F.col("licences")
    return license_scan(docs).select(
        "doc_id",
        F.size(each).cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(each["family"])), ",").alias("families"),
        F.to_json(F.transform(each, lambda x: F.struct(x["paragraph"], x["family"]))).alias("found"),
    )
