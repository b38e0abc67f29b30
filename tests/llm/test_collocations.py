"""Operator 11 against plain Python, and its perfect hash."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import collocations, perfect_hash


def test_perfect_hash_is_minimal_and_tells_others_apart():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(1, 400, (30_000, 5)).astype(np.int32), axis=0)
    keys[::3, 3:] = 0
    keys = np.unique(keys, axis=0)
    held = perfect_hash.build(keys)
    slots = perfect_hash.look_up(held, keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (held["keys"][slots] == keys).all()
    others = keys + 1_000
    assert (perfect_hash.look_up(held, others) == -1).all()
    assert (perfect_hash.look_up(perfect_hash.build(keys[:0]), keys) == -1).all()
    assert perfect_hash.look_up(perfect_hash.build(keys[:1]), keys[:2]).tolist() == [0, -1]
    with pytest.raises(ValueError, match="repeated"):
        perfect_hash.build(keys[[0, 0]])


def brute(rows, min_count, share=100, top=None):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    out = []
    for g, a in cand.items():
        lang, w = g[0], g[1:]
        if any(o[0] == lang and len(o) > len(g) and 100 * b >= share * a and any(o[i : i + len(w)] == w for i in range(1, len(o) - len(w) + 1)) for o, b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, done = Counter(), []
    for r in out:
        ranks[r[0]] += 1
        if top is None or ranks[r[0]] <= top:
            done.append((r[0], ranks[r[0]], *r[1:]))
    return done


def run(docs, **options):
    got = collocations.collocations(docs, **options).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize(
    "options",
    [{"top": None}, {"top": 7}, {"top": None, "block_keys": 300, "max_bits": 14}, {"top": 20, "block_bytes": 2_000}, {"top": None, "share": 60}],
)
def test_against_plain_python(spark, some_docs, options):
    docs = some_docs.limit(120).repartition(7)
    want = brute([(r["text"], r["lang"]) for r in docs.collect()], 6, options.get("share", 100), options["top"])
    assert len(want) > 20
    assert run(docs, min_count=6, **options) == sorted(want)


def test_edges(spark, edge_docs, no_docs):
    rows = [("a b, c d. A B\tc d;e  f\x0bg\x00h i é É", None), (None, "en"), ("", None), ("a b c d", None), ("a b c d", "und"), ("x " * 50, "de"), ("x.x!x?x:x\rx\x0cx\ny", "de")]
    docs = spark.createDataFrame(rows * 2, "text string, lang string")
    assert run(docs, min_count=2, top=None) == sorted(brute(rows * 2, 2))
    for least in (1, 2, 3):
        edge = [(r["text"], r["lang"]) for r in edge_docs.collect()]
        assert run(edge_docs, min_count=least, top=None) == sorted(brute(edge, least))
    assert run(no_docs, min_count=1) == run(docs, min_count=1_000) == []


def test_slices_of_long_texts(spark, monkeypatch):
    """Texts cut into slices, with words longer than a slice, give the same words in order."""
    r = random.Random(3)
    text = "".join(r.choice(["ab ", "c\t", "d. ", "e", "longer than a slice" * 9, "!? ", "\n"]) for _ in range(3_000)).encode()
    whole = [w for part in collocations.tokens([text, b"", text]) for w in part]
    monkeypatch.setattr(collocations, "SLICE", 50)
    assert [w for part in collocations.tokens([text, b"", text]) for w in part] == whole


def test_tree_of_many_tasks(spark):
    """More tasks than one group of the tree sums."""
    places = np.arange(0, collocations.CHUNK, 3, dtype=np.uint16)
    rows = [(0, k % 2, k, places[k % 5 :].tobytes(), np.full(len(places[k % 5 :]), k, np.uint32).tobytes()) for k in range(300)]
    got = collocations.tree_sum(spark.createDataFrame(rows, collocations.PARTIAL), 300).collect()
    assert len(got) == 2
    for g in got:
        want = np.zeros(collocations.CHUNK, np.int64)
        for _, chunk, k, at, _ in rows:
            if chunk == g["chunk"]:
                want[np.frombuffer(at, np.uint16)] += k
        assert (np.frombuffer(bytes(g["counts"]), np.int64) == want).all()


def test_products_beyond_64_bits():
    """Scores are whole-number quotients, whatever the size of the products."""
    import pyarrow as pa

    a, l, r, n = 10**13, 10**13 + 7, 10**14 + 9, 10**17
    cuts = np.zeros(len(collocations.CUTS), np.int64)
    cuts[collocations.CUTS.index((1, 0))], cuts[collocations.CUTS.index((1, 1))] = l, r
    taken = {}

    class Frame:
        def mapInArrow(self, f, schema):
            taken["f"] = f
            return self

    collocations.scored(Frame())
    batch = pa.RecordBatch.from_pydict({"key": [b"12345678"], "a": [a], "cuts": [cuts.tobytes()], "lang": ["en"], "n": [n], "words": [[b"x", b"y"]]})
    (out,) = taken["f"]([batch])
    assert out.to_pydict()["score"] == [1000 * a * n // (l * r)]
