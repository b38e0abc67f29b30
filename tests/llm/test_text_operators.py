import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate, license_scan, lm_score, packing, quality, registry, toxicity
from loomline.llm.common import scratch
from loomline.llm.html_extract import Weights, best_region, blocks, extract, html_extract
from loomline.llm.html_pages import PAGES
from loomline.llm.warc import parse, read_members, read_warc, write_warc

SF = "/root/testdata/sf0.001"


# --- decontamination
@pytest.mark.parametrize("block", [16 << 20, 100])
def test_decontaminate_against_brute_force(spark, some_docs, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "THE of"), (901, None), (None, "the"), (902, "..."), (900, "and THE")], "item_id long, text string"))
    items = [(str(r["item_id"]), decontaminate.item_words((r["text"] or "").encode())) for r in bench.collect() if r["item_id"] is not None]
    windows = {}
    for i, w in items:
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for r in decontaminate.decontaminate(some_docs, bench, block_bytes=block).collect():
        w = decontaminate.item_words((r["text"] or "").encode())
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        h = r["hits"]
        assert (h["n_words"], h["n_hit"], h["items"]) == (len(w), len(hit), sorted(found))
        inside = [x for s in h["spans"] for x in decontaminate.item_words(r["text"][s["start"] : s["end"]].encode())]
        assert inside == [w[k] for k in sorted(hit)]


def test_decontaminate_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "four five six")], "item_id long, text string")
    out = decontaminate.decontaminate(edge_docs, bench)
    assert out.columns == [*edge_docs.columns, "hits"] and out.where("hits.n_hit = 3").count() == 3
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(edge_docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0


# --- WARC
def test_warc_round_trip(spark):
    same, short = "x" * 100, "y" * 99
    rows = [(3, "http://a", same), (1, None, same), (2, "http://b b/ü\n", short), (4, "u", short), (5, "u", None), (6, "u", "é" * 50), (7, "u", "é" * 50), (None, "u", same), (9, "u", "z" * 3_000_000), (1, "again", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_id", F.lit(1))
    manifest = write_warc(pages, scratch(spark, "warc-test"), archive_bytes=2_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = read_warc(manifest).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [x["record_type"] for x in by["1"]] == ["response"] * 2 and by["3"][0]["refers_to"] == "1" == by[None][0]["refers_to"]
    assert by["7"][0]["refers_to"] == "6" and by["4"][0]["record_type"] == "response" and by["5"][0]["payload_bytes"] == 0
    assert bytes(by["9"][0]["payload"]) == b"z" * 3_000_000 and by["3"][0]["payload_digest"] == hashlib.sha256(same.encode()).hexdigest() and by["3"][0]["payload_bytes"] == 100
    empty = write_warc(pages.limit(0), scratch(spark, "warc-test"))
    assert empty.count() == 0 and read_warc(empty).count() == 0


def test_warc_damage_is_found():
    from loomline.llm.warc import record

    body = b"<p>hello</p>"
    raw = record("response", "1", "http://a", body, hashlib.sha256(body).hexdigest(), len(body), None, "1970-01-01T00:00:00Z")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(raw) + z.flush()
    assert [parse(m)["payload"] for m in read_members(io.BytesIO(data * 3))] == [body] * 3
    with pytest.raises(ValueError):
        list(read_members(io.BytesIO(data + data[:-5])))
    for bad in (raw.replace(b"hello", b"hallo"), raw[:-6], raw.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            parse(bad)


# --- HTML
def test_region_against_all_regions():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pairs = [(-float(g), float(v)) for g, v in zip(rng.integers(0, 3, 8), rng.integers(-6, 7, 8), strict=True)]
        best = max([0.0] + [sum(v for _, v in pairs[a:b]) + sum(g for g, _ in pairs[a + 1 : b]) for a in range(8) for b in range(a + 1, 9)])
        a, b, top = best_region(pairs)
        assert top == pytest.approx(best)
        assert a == b == 0 or top == pytest.approx(sum(v for _, v in pairs[a:b]) + sum(g for g, _ in pairs[a + 1 : b]))


def test_labelled_pages_and_articles(spark):
    import html
    import re

    w = Weights()
    right, bare = 0, 0
    for page in PAGES:
        found = blocks(page, labels=True)
        want = [i for i, b in enumerate(found) if b.label]
        right += w.region(found)[2] == want
        bare += w.region(found, scan=False)[2] == want
    assert right >= 0.99 * len(PAGES) and right >= bare + 20  # the scan decides
    for r in html_extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        a = re.sub(r"<[/a-z][^<>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", a))).split())
        assert r["main"]["text"] == want and r["main"]["n_chars"] == len(want)


MILL = "The old mill by the river was sold last week to a family from the coast, who want to bake bread there again."
HARD = [
    f"<body><div class='k1'><p>Win a bicycle today</p></div><article><!--+--><h1>The mill</h1><p>{MILL}</p><p>{MILL}</p><!----></article><div class='k2'><p>Tell your friends about us</p></div></body>",
    f"<body><main><!--+--><h1>The mill</h1><p>{MILL}</p><div class='sponsor'><p>{MILL}</p></div><!--+--><p>{MILL}</p><!----></main><section><p>Open from nine to five</p></section></body>".replace("<div class='sponsor'>","<!----><div class='sponsor'>"),
    f"<div id='top-bar'>Sale ends soon</div><div class='body-text'><!--+--><h2>Mill</h2><p>{MILL}</p><p>Sold.</p><!----></div><div class='zz'><div>Rate this page</div><div>Print it</div></div>",
    f"<article><header><!--+--><h1>Mill</h1><!----></header><!--+--><p>{MILL}</p><ul><li>one family</li><li>three ovens</li></ul><p>{MILL}</p><!----></article><section class='reader-comments'><p>{MILL}</p></section>",
    f"<body><div><a href='/'>Home</a></div><div><!--+--><p>{MILL}</p><p>{MILL}</p><p>{MILL}</p><!----></div><div><p>Ask us</p></div></body>",
    f"<div class='hero-header'><!--+--><h1>Mill</h1><p>{MILL}</p><p>{MILL}</p><!----></div><div class='w'><p>See all dates</p></div>",
    f"<body><section><p>Good to see you</p></section><section><!--+--><h1>Mill</h1><p>{MILL}</p><p>{MILL}</p><!----></section><section><p>Good bye</p></section></body>",
    f"<body><article><!--+--><h1>Mill</h1><p>{MILL}</p><!----><aside><p>{MILL}</p></aside><!--+--><p>The end.</p><!----></article><div><div><p>Read this too</p></div></div></body>",
]


def test_hard_pages_with_and_without_the_scan():
    """Pages of other markup than the labelled ones: F1 of words."""
    w, f1 = Weights(), {}
    for scan in (True, False):
        n = Counter()
        for page in HARD:
            found = blocks(page, labels=True)
            own = set(w.region(found, scan)[2])
            for i, b in enumerate(found):
                n[i in own, b.label] += b.n_words
        f1[scan] = 2 * n[True, True] / (2 * n[True, True] + n[True, False] + n[False, True])
    assert f1[True] > f1[False] + 0.02 and f1[True] > 0.9


def test_html_probes():
    import time

    w = Weights()
    text = lambda page: extract(page, w)[0]
    assert text("<p>foo<!---->bar is a word</p>") == "foobar is a word"
    assert text('<article><h1>T</h1><svg class="icon"/><p>All of the article is here.</p></article>') == "T All of the article is here."
    assert "All of the article is here." in text("<article><svg><path d='x'/><p>All of the article is here.</p></article>")
    assert text("<article><h1>A title here</h1><p>Some text of the page goes here and on.</p></article><div class='xyz'>Follow us on all networks</div>") == "A title here Some text of the page goes here and on."
    assert text("<div class='post-banner'><h1>A title</h1><p>This is an article inside a container with a strange name, and it is long enough.</p></div>").startswith("A title This")
    for page in ("<div>x " * 100_000, "<font>" * 100_000, "<p><table>" + "<font>" * 50_000 + "<hr>" * 50_000, "".join(f"<div class='c{k}'>x " for k in range(50_000))):
        began = time.process_time()
        text(page)
        assert time.process_time() - began < 5  # in proportion; the square would take minutes


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, "<nav><a>x</a></nav>"), (4, "<p>a &amp; b&nbsp;c"), (5, "<p>" + "many words " * 50_000), (6, "<p title='>'>q</p><script>if (a < b) {}</script"), (7, "a <b>b</b>c < d")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("main", F.lit("clash"))
    got = {r["page_id"]: r["main"]["text"] for r in html_extract(df).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] == "a & b c" and len(got[5].split()) == 100_000 and got[6] == "q" and got[7] == "a bc < d"
    assert html_extract(df.limit(0)).count() == 0


# --- packing
def test_boundaries_against_all_choices():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(150):
        h = [(n, rng.randint(1, 9)) for n in rng.sample(range(40), rng.randint(1, 7))]
        k = rng.randint(1, 4)
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in h)  # noqa: E731, B023
        top = max(n for n, _ in h)
        best = min(cost([*b, top]) for r in range(k) for b in itertools.combinations([n for n, _ in h if n != top], r))
        assert cost(packing.best_boundaries(h, k)) == best
    assert packing.best_boundaries([], 3) == []


@pytest.mark.parametrize("shard", [50_000, 7])
def test_pack(some_docs, edge_docs, no_docs, shard):
    for docs in (some_docs, edge_docs):
        n = {}
        for r in docs.collect():
            n.setdefault(r["doc_id"], []).append(len((r["text"] or "").encode().split()) + 1)
        rows = packing.pack(docs, max_tokens=512, buckets=4, budget=2048, shard_rows=shard).collect()
        total, batches = Counter(), {}
        for r in rows:
            total[r["doc_id"]] += r["n_tokens"]
            assert r["n_tokens"] + r["padding"] == r["bucket_tokens"] <= 512 and r["padding"] >= 0
            batches.setdefault((r["bucket_tokens"], r["batch"]), []).append(r["slot"])
        assert total == Counter({k: sum(v) for k, v in n.items()})
        for (b, no), slots in batches.items():
            per = 2048 // b
            last = max(x for c, x in batches if c == b)
            assert sorted(slots) == list(range(len(slots))) and len(slots) <= per and (no == last or len(slots) == per)
    assert packing.pack(no_docs).count() == 0


# --- language model
def interpolated(texts, learned):
    """The model by its formula, from plain counts of all n-grams: score(tokens), counts, n, v."""
    c = Counter()
    for t in learned:
        x = [b"\n", *t, b"\n"]
        c.update((w,) for w in x[1:])
        c.update(zip(x, x[1:], strict=False))
        c.update(zip(x, x[1:], x[2:], strict=False))
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    follow = Counter(g[:-1] for g in c)

    def p(w, *h):
        if not h:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        if h[-1] == b"\n" and len(h) > 1 or not c[h]:
            return p(w, *h[1:])
        return (max(c[(*h, w)] - 1, 0) + follow[h] * p(w, *h[1:])) / c[h]

    def score(t):
        x = [b"\n", *t, b"\n"]
        return sum(math.log10(p(x[i], *x[max(0, i - 2) : i])) for i in range(1, len(x)))

    return score, c, n, v, p


@pytest.mark.parametrize("sizes", [{}, {"slice_tokens": 500, "shard_tokens": 700, "window": 37}, {"window": 1}])
def test_lm_score_against_brute_force(spark, some_docs, sizes):
    docs = some_docs.select("doc_id", "text").limit(60 if sizes.get("window") == 1 else 10**6)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    score, c, n, v, p = interpolated(texts.values(), [t for i, t in texts.items() if i % 3])
    for h in [g for g in list(c)[:3000:30] if len(g) < 3 and g[-1] != b"\n"]:  # what a context leaves to words not seen is P(w)'s
        seen = [w for (w,) in (g for g in c if len(g) == 1)]
        assert sum(p(w, *h) for w in seen) == pytest.approx(1 - p(b'not seen', *h))
    out = lm_score.lm_score(docs, F.col("doc_id") % 3 > 0, **sizes).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        t = texts[r["doc_id"]]
        assert r["score"] == pytest.approx(score(t), rel=1e-9)
        assert (r["n_tokens"], r["train_tokens"]) == (len(t) + 1, n)
        assert r["n_known"] == sum(c[(w,)] > 0 for w in [*t, b"\n"])
        assert r["base_score"] == pytest.approx(sum(math.log10(p(w)) for w in [*t, b"\n"]))


def test_lm_probabilities_sum_to_one():
    texts = [b"a b a b c".split(), b"a b d".split(), b"a b".split(), b"c c c c".split()]
    _, c, n, v, p = interpolated(texts, texts)
    for h in [(), (b"a",), (b"b",), (b"c",), (b"\n",), (b"a", b"b"), (b"c", b"c"), (b"\n", b"a")]:
        assert sum(p(w, *h) for (w,) in (g for g in c if len(g) == 1)) + p(b"unseen", *h) == pytest.approx(1)


def test_lm_edges(spark, edge_docs, no_docs):
    out = lm_score.lm_score(edge_docs).collect()
    texts = [((r["text"] or "").encode().lower().split(), r["doc_id"]) for r in edge_docs.collect()]
    score, *_ = interpolated(*[[t for t, _ in texts]] * 2)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in out) == sorted((str(i), round(score(t), 6)) for t, i in texts)
    assert {r["score"] for r in lm_score.lm_score(edge_docs, F.lit(False)).collect()} == {0.0}
    assert {r["score"] for r in lm_score.lm_score(edge_docs, F.lit(None).cast("boolean")).collect()} == {0.0}
    assert lm_score.lm_score(no_docs, train=edge_docs).count() == 0
    apart = lm_score.lm_score(edge_docs.where("doc_id = 5"), F.lit(False), train=edge_docs).collect()
    assert [round(r["score"], 6) for r in apart] == [round(score(b"one two three four five six seven".split()), 6)] * 2


# --- classifiers
@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = registry.queries()[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    held = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(edge_docs, known, modulus=None)
        out = quality.quality(edge_docs, model, out_col="_h")
        assert out.count() == edge_docs.count() and out.where("_h is null or _h < 0 or _h > 1").count() == 0
        tox = toxicity.train(edge_docs, known, fold=None)
        out = toxicity.toxicity(edge_docs, tox, out_col="_h")
        assert out.columns == edge_docs.columns and out.where("_h is null or _h < 0 or _h > 1").count() == 0
        assert toxicity.toxicity(no_docs, tox).count() == quality.quality(no_docs, model).count() == 0


def test_rules_compile_to_what_they_score(spark, some_docs):
    labels = some_docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    model = quality.train(some_docs, labels, modulus=None)
    assert model.rules or model.linear
    rows = quality.statistics(some_docs).withColumn("got", model.column()).collect()
    x = np.array([[r["_s_" + s] for s in quality.STATISTICS] for r in rows])
    assert np.allclose(model.score(x), [r["got"] for r in rows])


def test_statistics_against_python(spark, some_docs):
    import re

    rows = [("A b, c!", None), ("x x x\nx x x\n\n12 %% | é", None), ("", None), (None, None)] + [(r["text"], None) for r in some_docs.limit(30).collect()]
    docs = spark.createDataFrame(rows, "text string, _s_digits double").withColumn("_s_t", F.lit("mine"))
    with pytest.raises(ValueError):
        quality.statistics(docs)
    prefix = quality.free_prefix(docs)
    for r in quality.statistics(docs, prefix=prefix).collect():
        t = r["text"] or ""
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        n, k, lines = len(t), len(w), t.split("\n")
        per = lambda x, of: x / max(of, 1)
        want = {
            "log_chars": math.log1p(n), "log_words": math.log1p(k), "word_length": per(n, k), "upper": per(sum(c.isupper() for c in t), n), "digits": per(len(re.findall("[0-9]", t)), n),
            "marks": per(len(re.findall("[.,;:?!]", t)), k), "symbols": per(len(re.findall(r"[%*&$#@^~_=+<>{}\[\]\\/|]", t)), n), "shouts": per(t.count("!"), k), "bars": per(t.count("|"), k),
            "distinct": per(len(set(w)), k), "repeats": per(sum(a == b for a, b in zip(w, w[1:], strict=False)), k), "lines": per(len(lines), k), "repeated_lines": 1 - per(len(set(lines)), len(lines)),
            "longest": math.log1p(max(map(len, w), default=0)),
        }
        assert {s: pytest.approx(r[prefix + s]) for s in quality.STATISTICS} == want and r["_s_t"] == "mine"


def test_convolution_against_loops():
    m = toxicity.Model(bits=8)
    rng = np.random.default_rng(5)
    m.E[1:] = rng.normal(0, 1, m.E[1:].shape)
    m.b = [rng.normal(0, 0.1, len(b)).astype(np.float32) for b in m.b]
    for text in ("one two three four", "a", "der Hund läuft über die Brücke und zurück " * 5):
        x = np.array([m.E[list(toxicity.buckets(w, m.bits))].sum(0) for w in toxicity.words(text)])
        x = np.concatenate([x, np.zeros((2, x.shape[1]))])  # what stands after the last word
        pooled = []
        for wide, W, b in zip(m.widths, m.W, m.b, strict=True):
            z = [np.concatenate(x[i : i + wide]) @ W for i in range(len(x) - 2)]
            pooled.append(np.max(z, 0) + b)
        want = np.maximum(np.concatenate(pooled), 0) @ m.u + m.c
        assert m.logits([text])[0][0] == pytest.approx(want, abs=1e-4)


def test_convolution_slices_agree():
    m = toxicity.Model()
    texts = ["a b c " * 30_000 + "idiot", None, "", "x", "one two three " * 500]
    whole = m.logits(texts)[0]
    old, toxicity.SLICE = toxicity.SLICE, 97
    try:
        assert np.allclose(m.logits(texts)[0], whole, atol=1e-5)
        assert np.allclose([m.logits([t])[0][0] for t in texts], whole, atol=1e-5)
    finally:
        toxicity.SLICE = old


def test_license_scan_against_python(spark, some_docs, edge_docs, no_docs):
    m = license_scan.default_model()
    extra = ["All rights reserved.\nx\nLicensed under the Foo License.", "The licensed driver\n\nReleased under the MIT License. ", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", None, ""]
    docs = some_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    found = 0
    for r in license_scan.license_scan(docs, model=m).collect():
        want = [(k, *c) for k, c in ((k, license_scan.classify(p, m)) for k, p in enumerate((r["text"] or "").split("\n"))) if c]
        assert [(x["paragraph"], x["family"]) for x in r["licences"]] == [w[:2] for w in want]
        assert [x["probability"] for x in r["licences"]] == pytest.approx([w[2] for w in want])
        found += len(want)
    assert found > 3 and license_scan.classify("Licensed under the Foo License.", m)[0] == "unknown"
    edges = license_scan.license_scan(edge_docs, model=m, out_col="_t").collect()
    assert len(edges) == edge_docs.count() and all(r["_t"] == [] for r in edges)
    assert license_scan.license_scan(no_docs, model=m).count() == 0


def test_license_scan_of_notices_not_learned_from(spark):
    m = license_scan.default_model()
    rows = [("Published under the GNU GPL, version 2 or later.", "gpl"), ("Released under CC BY 4.0.", "cc-by"), ("Text available under CC BY-SA 4.0.", "cc-by"), ("You may redistribute it and/or modify it under the terms of the GNU GPL as published by the Free Software Foundation.", None), ("The cat sat on the mat.", "")]
    docs = spark.createDataFrame([(t, want) for t, want in rows], "text string, want string")
    for r in license_scan.license_scan(docs, model=m).collect():
        got = [x["family"] for x in r["licences"]]
        assert got == ([r["want"]] if r["want"] else []) if r["want"] is not None else len(got) == 1


def test_license_scan_of_wordings_and_names_held_out():
    m = license_scan.default_model()
    right = seen = 0
    by = Counter()
    for c in license_scan.NAMES:
        for t in license_scan.notices(c, license_scan.HELD_WORDINGS):
            got = license_scan.classify(t, m)
            by[(got or ("none",))[0], c] += 1
            right, seen = right + (got is not None and got[0] == c), seen + 1
    assert right >= 0.97 * seen
    for c in license_scan.TEMPLATES:  # precision and recall by family
        assert by[c, c] >= 0.9 * sum(n for (_, want), n in by.items() if want == c) and by[c, c] >= 0.9 * sum(n for (got, _), n in by.items() if got == c)
    for t in ("Licensed under the Bar License.", "SPDX-License-Identifier: Acme-1.0", "Published under the Acme Public License.", "Released under the Quux license", "Made available under the Hippocratic License"):
        assert license_scan.classify(t, m)[0] == "unknown"
    for t in ("Nur mit ihm und mit dem Hund ging er unter der Brücke durch", "The only way to see the project is under the bridge", "The licensed driver", "the public walked in the garden"):
        assert license_scan.classify(t, m) is None


def test_license_triggers_lose_nothing(some_docs):
    """Texts without a trigger are ordinary, whatever known grams they are made of."""
    m = license_scan.default_model()
    triggers, rng = set(m.triggers), np.random.default_rng(3)
    free = [g for g in m.grams if not triggers & set(g.split())]
    for n in (1, 3, 10, len(free)):
        for _ in range(30):
            text = " . ".join(rng.permutation(free)[:n])
            assert license_scan.classify(text, m) is None
    for own in m.templates.values():
        for pairs in own:  # the pairs without a trigger are too few to confirm
            assert sum(not triggers & set(p.split()) for p in pairs) < m.similarity * len(pairs)
    words = sorted(triggers)
    import re

    pattern = re.compile("(?<![a-z0-9])" + license_scan.alternatives(words) + "(?![a-z0-9])")
    assert all(pattern.search(f"x {w}.") for w in words) and not any(pattern.search(f"{w}s0") or pattern.search("q" + w) for w in words)


def test_license_scan_plan_is_native(spark, some_docs):
    plan = license_scan.license_scan(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_license_scan_of_wrapped_notices(spark):
    import textwrap

    rows = []
    for c, own in license_scan.TEMPLATES.items():
        for t in own:
            wrapped = "\n".join("# " + x for x in textwrap.wrap(t, 76))
            if "\n" in wrapped:
                rows += [(wrapped, [c]), ("The first line of a file.\n" + wrapped + "\nand more of it", [c])]
    gpl, mit = ("\n".join(textwrap.wrap(license_scan.TEMPLATES[c][k], 60)) for c, k in (("gpl", 1), ("mit", 3)))
    rows += [(gpl + "\n\n" + mit, ["gpl", "mit"]), (gpl + "\n" + mit, ["gpl", "mit"]), ("Licensed under the Foo License.\n\n" + gpl, ["gpl", "unknown"])]
    got = license_scan.license_scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r["k"]: sorted({x["family"] for x in r["licences"]}) for r in got} == {k: want for k, (_, want) in enumerate(rows)}
