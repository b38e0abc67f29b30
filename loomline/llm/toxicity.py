"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of the rows of its hash and of the hashes of its first four
and five letters. Filters of several widths run over the words, each keeps its largest
value in the text (max pooling), and a linear layer gives the logit. Thresholds are
calibrated by language, which is told from the text itself by its commonest short words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, lean, table, tune

#: Letters stay, all other ASCII bytes end a word.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Short common words that tell a language.
STOPWORDS = {
    "en": "the of and to in is that it was for on are as with be this at by from not or which have",
    "fr": "le la les de des et un une du que qui dans est pour sur pas au par avec elle il ce ne",
    "de": "der die das und den dem ist von zu mit sich des auf nicht ein eine als auch es im für",
    "es": "el la los las de que y en un una es se del al con por para su no lo como más",
}
LANGS = (*STOPWORDS, "other")
_OF = {w.encode(): tuple(w in STOPWORDS[x].split() for x in STOPWORDS) for v in STOPWORDS.values() for w in v.split()}
_NONE = (False,) * len(STOPWORDS)
SLICE = 1 << 15
#: Words that a task remembers.
WORDS = 150_000


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def buckets(word: bytes, bits: int) -> tuple[int, int, int]:
    """Hash buckets (from 1 on) of the word and of its first five and four letters."""
    mask, text = (1 << bits) - 1, word.decode("utf-8", "replace")
    return tuple(1 + (zlib.crc32(x.encode(), seed) & mask) for seed, x in ((1, text), (2, text[:5]), (3, text[:4])))


class Vocabulary:
    """Numbers words as they come; keeps each number's buckets and language flags."""

    def __init__(self, bits: int):
        self.bits, self.of, self.new = bits, {}, []
        self.rows = np.zeros((1, 3), np.int64)  # number 0 is padding
        self.langs = np.zeros((1, len(STOPWORDS)), np.int32)

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, two paddings after each, and where each text begins."""
        of, ids, starts = self.of, [], [0]
        for text in texts:
            for w in words(text):
                k = of.get(w)
                if k is None:
                    k = of[w] = len(of) + 1
                    self.new.append(w)
                ids.append(k)
            ids += (0, 0)
            starts.append(len(ids))
        if self.new:
            self.rows = np.concatenate([self.rows, np.array([buckets(w, self.bits) for w in self.new], np.int64)])
            self.langs = np.concatenate([self.langs, np.array([_OF.get(w, _NONE) for w in self.new], np.int32)])
            self.new = []
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def language(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Place in LANGS of each text's language: most short common words; none: other."""
        counts = np.add.reduceat(self.langs[ids], starts[:-1], axis=0)
        return np.where(counts.max(1) > 0, counts.argmax(1), len(STOPWORDS))


class Model:
    """Parameters, and their training."""

    def __init__(self, bits: int = 16, dim: int = 12, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), seed: int = 7):
        r = np.random.default_rng(seed)
        self.bits, self.widths = bits, widths
        self.E = r.normal(0, 0.02, ((1 << bits) + 1, dim)).astype(np.float32)
        self.E[0] = 0
        self.W = [r.normal(0, (2 / (k * dim)) ** 0.5, (k * dim, filters)).astype(np.float32) for k in widths]
        self.b = [np.zeros(filters, np.float32) for _ in widths]
        self.u = r.normal(0, 0.3, filters * len(widths)).astype(np.float32)
        self.c = np.float32(-1)
        self.shift = np.zeros(len(LANGS))  # logit at which the score is 1/2, by language
        self.constant: float | None = None

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, updates: int = 4_000, batch: int = 32, rate: float = 0.05, least: int = 3, patience: int = 6, seed: int = 7):
        """Adagrad on the weighted log loss. Buckets in under `least` texts embed as 0,
        so that words seen once or twice can't be learned by heart; all start close to 0.
        About `updates` steps are made, in 12 to 100 passes at most: of the passes up to
        `patience` ones without a smaller loss on a held-out fifth, the best one counts."""
        if len(set(y.tolist())) < 2:
            self.constant = float((weight * y).sum() + 0.5) / float(weight.sum() + 1) if len(y) else 0.5
            return self
        vocabulary = Vocabulary(self.bits)
        ids, starts = vocabulary.read(texts)
        rows = vocabulary.rows[ids]
        n_texts = np.zeros(len(self.E), np.int32)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            n_texts[np.unique(rows[a : b - 2])] += 1
        self.E[n_texts < least] = 0
        rows[n_texts[rows] < least] = 0
        r = np.random.default_rng(seed)
        hold = r.random(len(y)) < 0.2  # calibrates, isn't fitted
        if min(y[~hold].sum(), (1 - y[~hold]).sum()) < 1:
            hold[:] = False
        fit = np.flatnonzero(~hold)
        dim, nf = self.E.shape[1], len(self.b[0])
        g_e = np.full(len(self.E), 1e-2, np.float32)
        slow = [np.full_like(p, 1e-2) for p in (*self.W, *self.b, self.u)]
        g_c = 1e-2
        checks = np.flatnonzero(hold) if hold.sum() >= 20 else fit[:0]
        best, kept, late = np.inf, None, 0
        for _ in range(min(100, max(12, -(-updates * batch // max(1, len(fit)))))):
            r.shuffle(fit)
            for k in range(0, len(fit), batch):
                which = fit[k : k + batch]
                spans = [(starts[i], starts[i + 1]) for i in which]
                at = np.concatenate([np.arange(a, b) for a, b in spans])
                cut = np.cumsum([0, *[b - a for a, b in spans]])
                br = rows[at]
                x = self.E[br].sum(1)
                pooled, where = [], []
                for w, (W, b) in enumerate(zip(self.W, self.b, strict=True)):
                    wide = self.widths[w]
                    z = sum(x[j : len(x) - 2 + j] @ W[j * dim : (j + 1) * dim] for j in range(wide))
                    top = np.stack([z[s : e - 2 if e - s > 2 else s + 1].argmax(0) + s for s, e in zip(cut[:-1], cut[1:], strict=True)]) if len(z) else np.zeros((len(which), nf), np.int64)
                    top = np.minimum(top, max(len(z) - 1, 0))
                    pooled.append(np.take_along_axis(z, top, 0) + b if len(z) else np.tile(b, (len(which), 1)))
                    where.append(top)
                m = np.concatenate(pooled, 1)
                keep = (r.random(m.shape) > 0.2) / 0.8
                h = np.maximum(m, 0) * keep
                d = (weight[which] * (1 / (1 + np.exp(-np.clip(h @ self.u + self.c, -30, 30))) - y[which]) / len(which)).astype(np.float32)
                dm = (d[:, None] * self.u * keep * (m > 0)).astype(np.float32)
                grads_w, grads_b, touched, moved = [], [], [], []
                for w, (W, top) in enumerate(zip(self.W, where, strict=True)):
                    g = dm[:, w * nf : (w + 1) * nf]
                    gw = np.empty_like(W)
                    for j in range(self.widths[w]):
                        place = np.minimum(top + j, len(x) - 1)
                        gw[j * dim : (j + 1) * dim] = np.einsum("nfd,nf->df", x[place], g)
                        touched.append(br[place].reshape(-1, 3))
                        moved.append((W[j * dim : (j + 1) * dim].T[None] * g[:, :, None]).reshape(-1, dim))
                    grads_w.append(gw)
                    grads_b.append(g.sum(0))
                for p, g, s in zip((*self.W, *self.b, self.u), (*grads_w, *grads_b, h.T @ d), slow, strict=True):
                    s += g * g
                    p -= rate * g / np.sqrt(s)
                g_c += float(d.sum()) ** 2
                self.c = np.float32(self.c - rate * d.sum() / g_c**0.5)
                hit, grad = np.concatenate(touched), np.concatenate(moved)
                own, inverse = np.unique(hit, return_inverse=True)
                total = np.zeros((len(own), dim), np.float32)
                inverse = inverse.reshape(hit.shape)
                for j in range(3):
                    np.add.at(total, inverse[:, j], grad)
                total[own == 0] = 0
                g_e[own] += (total * total).mean(1)
                self.E[own] -= rate * total / np.sqrt(g_e[own])[:, None]
            if len(checks):  # the pass of the least loss on texts that aren't fitted counts
                z = np.clip(self.logits([texts[i] for i in checks])[0], -30, 30)
                loss = float((weight[checks] * (np.logaddexp(0, z) - y[checks] * z)).mean())
                late += 1
                if loss < best:
                    best, late = loss, 0
                    kept = (self.E.copy(), [W.copy() for W in self.W], [b.copy() for b in self.b], self.u.copy(), self.c)
                if late >= patience:
                    break
        if kept is not None:
            self.E, self.W, self.b, self.u, self.c = kept
        cal = np.flatnonzero(hold) if hold.sum() >= 20 else np.arange(len(y))
        part = [texts[i] for i in cal]
        logits, langs = self.logits(part)
        self._calibrate(logits, langs, y[cal], weight[cal])
        return self

    def _calibrate(self, logits, langs, y, weight, prior: float = 30.0, miss: float = 3.0):
        """Per language the logit at which a miss costs as much as a false alarm, by a logistic
        fit on the logits in which a toxic text weighs `miss` times a clean one, drawn towards that of all languages where few toxic texts speak for it.
        The fit is smooth: where no text lies between the labels, it doesn't matter which one
        comes next to the gap."""

        def even(keep):
            z, t, w = logits[keep].astype(float), y[keep], weight[keep] * np.where(y[keep] > 0, miss, 1.0)
            middle, wide = z.mean(), z.std() + 1e-9
            a, v = np.column_stack([(z - middle) / wide, np.ones(len(z))]), np.zeros(2)
            for _ in range(50):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
                v -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (w * (p - t)) + 1e-3 * v)
            return float(np.clip(middle - wide * v[1] / max(v[0], 1e-6), z.min() - 4, z.max() + 4))

        every = np.ones(len(y), bool)
        overall = even(every) if len(set(y.tolist())) == 2 else 0.0
        for k in range(len(LANGS)):
            own = langs == k
            n = min(y[own].sum(), (1 - y[own]).sum()) if own.any() else 0
            self.shift[k] = overall if n < 5 else (n * even(own) + prior * overall) / (n + prior)

    def logits(self, texts: list[str | None], vocabulary: Vocabulary | None = None, table: list | None = None):
        """Logit and language of each text, over all its words."""
        v = vocabulary or Vocabulary(self.bits)
        ids, starts = v.read(texts)
        nf = len(self.b[0])
        if table is None:
            table = [np.zeros((0, sum(self.widths) * nf), np.float32)]
        if len(table[0]) < len(v.rows):  # what each word adds to each filter at each offset
            x = self.E[v.rows[len(table[0]) :]].sum(1)
            dim = x.shape[1]
            add = np.concatenate([x @ W[j * dim : (j + 1) * dim] for W, wide in zip(self.W, self.widths, strict=True) for j in range(wide)], 1)
            table[0] = np.concatenate([table[0], add])
        m = np.full((len(texts), nf * len(self.widths)), -np.inf, np.float32)
        for a in range(0, len(ids) - 2, SLICE):
            b = min(a + SLICE, len(ids) - 2)
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b - 1, "right") - 1
            cut = np.maximum(starts[first : last + 1], a) - a
            part = table[0][ids[a : b + 2]]
            at = 0
            for w, wide in enumerate(self.widths):
                z = part[: b - a, at : at + nf].copy()
                for j in range(1, wide):
                    z += part[j : b - a + j, at + j * nf : at + (j + 1) * nf]
                at += wide * nf
                z[ids[a:b] == 0] = -np.inf  # windows begin at words
                own = m[first : last + 1, w * nf : (w + 1) * nf]
                np.maximum(own, np.maximum.reduceat(z, cut, axis=0), out=own)
        m[~np.isfinite(m)] = 0
        return np.maximum(m + np.concatenate(self.b), 0) @ self.u + self.c, v.language(ids, starts)

    def scores(self, texts: list[str | None], vocabulary: Vocabulary | None = None, table: list | None = None) -> np.ndarray:
        """Scores from 0 to 1; 1/2 is the calibrated threshold of the text's language."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits, langs = self.logits(texts, vocabulary, table)
        return 1 / (1 + np.exp(-np.clip(logits - self.shift[langs], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_each: int = 3_000, max_chars: int = 30_000_000, fold: int | None = 5) -> Model:
    """Fit on a bounded sample: of each label the rows of the least hashes of the id, whole
    texts, max_each at most and max_chars characters in all. A text that doesn't fit into what is
    left of max_chars is passed over, but the first of a label is always taken. fold: rows whose
    crc32(doc_id) is divisible by it are left out; None uses all.

    Weights restore the labels' shares. Null labels, ids without a text and null texts
    are left out; if one label is missing, the score is constant.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    if fold:
        known = known.where(doc_fold(F.col("doc_id"), fold) != 0)
    known = known.select("doc_id", (F.col(label_col) > 0).cast("int").alias("_y"))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts, y = [], []
    for k in sorted(shares):
        sample = known.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_each)
        rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample.select("doc_id")), "doc_id")
        sizes = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
        left, chosen = max_chars, set()
        for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
            if r["n"] <= left or not chosen:  # the first text counts even if it alone is longer
                left -= r["n"]
                chosen.add(r["doc_id"])
        few = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], sample.select("doc_id").schema)
        got = sorted((r["doc_id"], r["text"]) for r in rows.join(F.broadcast(few), "doc_id", "left_semi").collect())
        texts += [t for _, t in got]
        y += [k] * len(got)
    y = np.array(y, np.float32)
    weight = np.array([shares[int(k)] / max(1, (y == k).sum()) for k in y], np.float32)
    weight *= len(y) / weight.sum() if len(y) else 1
    if len(y):  # half-way to even shares, for the rarer label not to be drowned
        weight = np.sqrt(weight)
    return Model().fit(texts, y, weight)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Rows of `docs` with out_col (0 to 1; toxic from 1/2 on) added, or in its place.

    Whole texts are scored, in slices, whatever their length; null and empty texts have no
    word and get the model's score for that; nothing but the text is an input. Repeated
    rows get equal scores, an empty table gives no rows, other columns pass unchanged.
    """
    spark = docs.sparkSession
    tune(spark)
    # Plain arrays, of fixed size, (2^bits + 1) rows: a broadcast of a Model would be pickled by
    # the name of its class, which workers without this package can't import.
    shared = spark.sparkContext.broadcast(vars(model))
    out = docs.withColumn(out_col, F.lit(None).cast("double"))
    at, put = docs.columns.index(text_col), out.columns.index(out_col)

    def run(batches):
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        vocabulary, by_word = Vocabulary(model.bits), [np.zeros((0, sum(model.widths) * len(model.b[0])), np.float32)]
        for batch in batches:
            columns = list(batch.columns)
            texts, scores = batch.column(at), []
            for k in range(0, len(texts), 100):
                if len(vocabulary.of) > WORDS:
                    vocabulary, by_word = Vocabulary(model.bits), [by_word[0][:0].copy()]
                scores.append(model.scores(texts.slice(k, 100).to_pylist(), vocabulary, by_word))
            columns[put] = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(lean(run), out.schema)


def op9_toxicity(spark, sf_dir):
    """Toxicity of every text of `documents`; edge cases as toxicity() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, out_col="score").select(
        "doc_id",
        (doc_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
