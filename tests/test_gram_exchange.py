"""N-gram statistics by chunks and shards against plain counting."""

from collections import Counter, defaultdict

import pytest

from loomline.operators import diversity

ORDERS = (1, 2, 3, 4)
TEXTS = ["the cat sat on the mat", "The cat sat. On the mat!", "the the the the", "", None, "one", "a cat sat on a mat " * 40, "été Été ß _x 9", "the cat sat on the mat"]


def counted(texts):
    import re

    words = [re.findall(r"[^\W]+", (t or "").lower()) for t in texts]
    return [{n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in ORDERS} for w in words]


@pytest.fixture(scope="module")
def rows():
    return [(g, k, t) for g in ("x", "y", None) for k, t in enumerate(TEXTS if g != "y" else TEXTS[2:] * 3)]


@pytest.mark.parametrize("chunk_words, shard_grams", [(7, 11), (100, 50), (500_000, 4_000_000)])
def test_gram_stats_whatever_the_cut(spark, rows, chunk_words, shard_grams):
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(3)
    got = diversity.gram_stats(df, ["g"], "t", "k", ORDERS, chunk_words, shard_grams).collect()
    assert len(got) == len(rows)
    own = defaultdict(int)
    for g in ("x", "y", None):
        counts = counted([t for h, _, t in rows if h == g])
        mine = {r["_k"]: r for r in got if r["g"] == g}
        for k, c in enumerate(counts):
            assert mine[k]["_len"] == sum(c[1].values())
            for n in ORDERS:
                hit = sum(min(v, max((o[n][x] for j, o in enumerate(counts) if j != k), default=0)) for x, v in c[n].items())
                assert (mine[k][f"total_{n}"], mine[k][f"hit_{n}"]) == (sum(c[n].values()), hit)
                own[g, n] += mine[k][f"own_{n}"]
        for n in ORDERS:
            assert own[g, n] == len(set().union(*[c[n] for c in counts]))


def test_a_gram_is_asked_for_once_a_chunk(spark):
    """Before, a row for each text that has it was shuffled, twice."""
    import pyarrow as pa

    n = 300
    chunk, ask, answer, _ = diversity._steps((1, 2), 10_000)
    g = pa.StructArray.from_arrays([pa.array(range(n))], ["_k"])
    batch = pa.RecordBatch.from_arrays([g, pa.array([5] * n), pa.array([[1, 2, 3]] * n)], names=["g", "h", "w"])
    from pyspark import TaskContext

    was, TaskContext.get = TaskContext.get, staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())
    try:
        chunks = list(chunk(iter([batch])))
    finally:
        TaskContext.get = was
    asked = [r for b in ask(4)(iter(chunks)) for r in b.to_pylist()]
    assert len(chunks) == 1 and sum(len(r["key"]) for r in asked) == 8 * 5
    told = [r for b in answer(iter([pa.RecordBatch.from_pylist(asked)])) for r in b.to_pylist()]
    assert {r["other"] for r in told} <= {bytes([1] * k) for k in range(1, 6)}  # no other chunk; counted here
