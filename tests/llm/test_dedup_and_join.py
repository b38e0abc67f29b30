import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, ngram_join
from loomline.llm.components import components
from loomline.llm.signature_tree import Forest, join, similar


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hot", [1_000, 2])
def test_content_sort_is_exact(spark, some_docs, keep, hot):
    rows = some_docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in exact_dedup.content_sort(some_docs, keep=keep, hot_rows=hot).collect()}
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", []).append(r["doc_id"])
    assert len(got) == len(rows)
    for text, ids in by.items():
        for i in ids:
            best = (min if keep == "min" else max)(ids)
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(ids), i == best)
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("hot", [1_000, 1])
def test_content_sort_edges(edge_docs, no_docs, hot):
    out = exact_dedup.content_sort(edge_docs, keep="max", hot_rows=hot).collect()
    assert len(out) == edge_docs.count()
    empty = [r for r in out if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {2} and {r["group_size"] for r in empty} == {3} and sum(r["kept"] for r in empty) == 1
    seven = [r for r in out if r["doc_id"] == 5]
    assert [r["group_size"] for r in seven] == [3, 3] and sum(r["kept"] for r in seven) == 1
    kept = exact_dedup.survivors(edge_docs, hot_rows=hot)
    assert kept.columns == edge_docs.columns and kept.count() == 6
    assert exact_dedup.content_sort(no_docs).count() == 0


def brute_groups(docs, k, percent):
    sets = []
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    f = Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                f.union(i, j)
    return [f.find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 90, 2_000_000), (5, 80, 500)])
def test_jaccard_groups_against_all_pairs(spark, some_docs, k, percent, tile):
    base = some_docs.orderBy("doc_id").collect()
    rng, rows = random.Random(1), [(r["doc_id"], r["text"]) for r in base]
    for n in range(60):  # near copies of one text, and of some others
        w = base[3 if n < 30 else n]["text"].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        rows.append((10_000 + n, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.jaccard_groups(docs, k=k, percent=percent, tile_tokens=tile).collect()}
    group, size = brute_groups([{"text": t} for _, t in rows], k, percent)
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    for g, n, (i, _) in zip(group, size, rows, strict=True):
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (least[g], n, least[g] == i)
    assert sum(group[x] != x for x in range(len(rows))) > 20
    kept = ngram_join.survivors(docs, k=k, percent=percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_a_thousand_documents_against_all_pairs(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = docs.orderBy("doc_id").collect()
    group, size = brute_groups(base, k, percent)
    least = {g: min(r["doc_id"] for r, x in zip(base, group, strict=True) if x == g) for g in set(group)}
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in ngram_join.jaccard_groups(docs, k=k, percent=percent).collect()}
    assert got == {r["doc_id"]: (least[g], n) for r, g, n in zip(base, group, size, strict=True)}


def test_links_of_every_row(spark):
    """n_links counts all linked rows, in a block of many tiles as in one of one."""
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(words[:-1] + [f"x{k % 7}"])) for k in range(30)] + [(100, "alone here"), (101, ""), (102, " ".join(f"y{k}" for k in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2_000_000, 100):
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_groups(docs, k=3, percent=90, tile_tokens=tile, links=True).collect()}
        assert all(got[k] == (0, 29) for k in range(30)) and got[100] == (100, 0) and got[101] == (101, 0) and got[102] == (102, 0)


def test_ten_thousand_null_ids(spark):
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one text of some words that all have in common number "), (F.col("id") % 100).cast("string"), F.lit(" and what follows it to the end")).alias("text"))
    out = ngram_join.jaccard_groups(docs, k=3, percent=50)
    assert out.count() == 10_000 and out.where("component_id is not null").count() == 0 and out.where("kept").count() >= 1


def test_jaccard_edges(edge_docs, no_docs):
    out = ngram_join.jaccard_groups(edge_docs).collect()
    assert len(out) == edge_docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(1, 4, True)]
    assert by[5] == [(3, 5, True)] * 2 and sorted(by[None], key=str) == [(0, None, True), (3, 5, False)]
    assert by[7] == [(3, 7, True)] and by[8] == [(4, 8, True)]  # 90,000 words, few shingles
    assert ngram_join.jaccard_groups(no_docs).count() == 0
    kept = ngram_join.survivors(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 9


def test_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(2)
    for percent in (90, 80):
        keys = ngram_join.Keys(percent)
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**64 - 1, int(rng.integers(1, 300)), dtype=np.uint64))
            b = a.copy()
            b[: int(len(a) * rng.random() * (100 - percent) / 150)] = 7
            b = np.unique(b)
            if similar(a, b, percent):
                assert set(keys(a).tolist()) & set(keys(b).tolist())


def test_signature_trees_lose_no_component():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = []
        for _ in range(25):
            b = sets[int(rng.integers(len(sets)))].copy() if sets and rng.random() < 0.6 else rng.integers(0, 2**63, int(rng.integers(1, 90)), dtype=np.uint64)
            b[: len(b) // 9] = rng.integers(0, 2**63, len(b) // 9, dtype=np.uint64)
            sets.append(np.unique(b))
        want, got = Forest(25), Forest(25)
        for i in range(25):
            for j in range(i):
                if similar(sets[i], sets[j], 80):
                    want.union(i, j)
        for i, j in join(sets, 80):
            got.union(i, j)
        assert [want.find(i) for i in range(25)] == [got.find(i) for i in range(25)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 5), (5, 1), (9, 5), (7, 7), (2, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 100 for k in range(100, 161)) and got[9] == got[5] == got[1] == 1 and got[3] == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
