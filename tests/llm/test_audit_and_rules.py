"""Operators 12 and 13 against plain Python."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.llm import filter_audit, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    masks = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        m = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t))]
        m.append(i is not None and any((o or "") == t and j is not None and j < i for j, o, _ in docs))
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if j is not None)
        masks.append((part or "", m, good, toxic))
    out, shapley = {}, Counter()
    for order in itertools.permutations(range(5)):
        for step, f in enumerate(order, 1):
            for part in {p for p, *_ in masks}:
                c = Counter()
                for p, m, good, toxic in masks:
                    if p != part:
                        continue
                    gone = any(m[x] for x in order[: step - 1])
                    c["kept"] += not gone and not m[f]
                    c["removed"] += m[f] and not gone
                    c["redundant"] += m[f] and gone
                    c["unique_fails"] += m[f] and sum(m) == 1
                    c["good_lost"] += m[f] and not gone and good
                    c["toxic_lost"] += m[f] and not gone and toxic
                shapley[part, f] += c["removed"]
                out[part, "".join("ABCDE"[x] for x in order), step] = c
    for (part, order, step), c in out.items():
        c["shapley"] = shapley[part, "ABCDE".index(order[step - 1])]
    return out


def check_audit(docs, labels, got):
    want = brute_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()])
    got = {(r["part"], r["filter_order"], r["step"]): r for r in got.collect()}
    assert set(got) == set(want)
    for key, c in want.items():
        assert {k: got[key][k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {k: int(c[k]) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}


def test_audit_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (8, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    check_audit(edge_docs, labels, filter_audit.audit(edge_docs, labels))
    check_audit(edge_docs, labels.limit(0), filter_audit.audit(edge_docs, labels.limit(0)))
    assert filter_audit.audit(no_docs, labels).count() == 0


def test_audit_of_the_table(spark, some_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    docs = some_docs.union(some_docs.limit(40).withColumn("doc_id", F.col("doc_id") + 10_000))
    check_audit(docs, labels, filter_audit.audit(docs, labels))


def test_copies_across_partitions(spark):
    """One text holds nearly all rows, some ids repeat, and ranges cut the run many times."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k // 2 if k < 400 else k, "same text", "en") for k in range(4_000)] + [(k, f"other {k % 700}", "de") for k in range(4_000, 5_000)] + [(None, "same text", "en")] * 5
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16)
        found = filter_audit.masks(docs)
        got = Counter()
        for r in found.collect():
            got[r["id"], r["part"], r["mask"] & filter_audit.COPY] += r["n"]
        least = {}
        for i, t, _ in rows:
            if i is not None:
                least[t] = min(least.get(t, i), i)
        want = Counter((i, p, filter_audit.COPY if i is not None and i > least[t] else 0) for i, t, p in rows)
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[w[i], w[i + 1], w[i + 2]] > 1}
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines), len(re.findall("[A-Z]", t)), sum(a == b for a, b in zip(w, w[1:])))


def test_counts(some_docs, edge_docs):
    texts = [r["text"] for r in some_docs.select("text").collect() + edge_docs.select("text").collect()]
    texts += ["a b c a b c", "a b", "é è x \x0b y\n\n \ny\ny", "x x x x", "#|<>"]
    for t in texts:
        assert quality_rules.text_counts((t or "").encode()) == brute_counts(t)


def test_long_texts_count_alike(monkeypatch):
    words = [b"w%d" % (k * k % 37) for k in range(3_000)] + [b"x%d" % k for k in range(500)]
    table = quality_rules.repeated_words(words)
    monkeypatch.setattr(quality_rules, "LONG", 10)
    assert quality_rules.repeated_words(words) == table > 0


def brute_fences(rows, least):
    """rows: (lang, source, counts). Sketches as sorted lists of bucket values."""

    def low_end(v):
        shift = max(v.bit_length() - 6, 0)
        return v >> shift << shift

    def of(keep):
        out = {}
        for name, (over, under, _, _) in quality_rules.RATIOS.items():
            vs = sorted(low_end(1000 * c[over] // c[under] if c[under] else 0) for lang, source, c in rows if c["n_words"] and keep(lang, source))
            out[name] = vs
        return out

    fences = {}
    for lang, source in {(a, b) for a, b, c in rows if c["n_words"]}:
        own, of_lang, every = of(lambda a, b: (a, b) == (lang, source)), of(lambda a, _: a == lang), of(lambda *_: True)
        for name, (_, _, spread, has_low) in quality_rules.RATIOS.items():
            vs = next(v for v in (own[name], of_lang[name], every[name]) if len(v) >= least or v is every[name])
            q1, q3 = vs[-(-len(vs) // 4) - 1], vs[-(-3 * len(vs) // 4) - 1]
            s = quality_rules.REACH * max(q3 - q1, spread)
            fences[lang, source, name] = (q1 - s if has_low else 0, q3 + s)
    return fences


@pytest.mark.parametrize(("least", "max_broadcast"), [(1, 100_000), (12, 0), (60, 100_000), (10_000, 0)])
def test_rules_against_plain_python(some_docs, least, max_broadcast):
    rows = some_docs.select("doc_id", "text", "lang", "source").collect()
    counts = {r["doc_id"]: dict(zip(quality_rules.COUNTS, brute_counts(r["text"]))) for r in rows}
    fences = brute_fences([(r["lang"] or "", r["source"] or "", counts[r["doc_id"]]) for r in rows], least)
    got = {r["row"]["doc_id"]: r for r in quality_rules.quality_rules(some_docs, least=least, max_broadcast=max_broadcast).collect()}
    assert len(got) == len(rows)
    for r in rows:
        c, g = counts[r["doc_id"]], got[r["doc_id"]]
        assert g["counts"].asDict() == c
        failed = []
        for name, (over, under, _, _) in quality_rules.RATIOS.items():
            v = 1000 * c[over] // c[under] if c[under] else 0
            low, high = fences.get((r["lang"] or "", r["source"] or "", name), (v, v))
            failed += [name] * (not low <= v <= high)
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        assert (g["base_failed"], g["failed"], g["kept"]) == (base, sorted(failed), not base and not failed)


def test_rules_edges(edge_docs, no_docs):
    got = quality_rules.quality_rules(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in got)  # short, or one phrase over and over
    assert set(got[0]["row"].asDict()) == set(edge_docs.columns) - {"text"}
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_rules_against_labels(spark):
    """Held against the quality labels of a larger table: junk goes, clean documents stay."""
    sf = "/root/testdata/sf0.01"
    kept = quality_rules.op13_quality_rules(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in kept.join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()}
    junk, clean = n.get((0, False, True), 0), n.get((1, False, False), 0)
    assert junk <= 0.02 * sum(v for (q, _, _), v in n.items() if q == 0)
    assert clean <= 0.02 * sum(v for (q, _, _), v in n.items() if q == 1)
