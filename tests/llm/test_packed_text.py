"""Sequences with their text, record ids of repeated pages, and benchmarks of many blocks."""

import gc
import tracemalloc

import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate, packing, warc
from loomline.llm.common import scratch


@pytest.mark.parametrize("most", [1, 3, 50, 4096])
def test_sequences_rebuild_every_text(spark, some_docs, most):
    extra = [(10_001, None), (10_002, ""), (10_003, " \t\n "), (10_004, "\none  two\t\x0bthree \n"), (10_005, "a b c"), (10_006, "a b c ")]
    docs = some_docs.select("doc_id", "text").limit(40).union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack(docs, max_tokens=most, text_out="part").collect()
    plain = packing.pack(docs, max_tokens=most).drop("part").collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(tuple(r)[:4] for r in plain)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    built = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["sequence"])):
        n = len(r["part"].encode().split())
        built[r["doc_id"]] = built.get(r["doc_id"], "") + r["part"]
        assert r["n_tokens"] in (n, n + 1) and n <= most
    assert built == texts


def test_text_needs_words(edge_docs, no_docs):
    with pytest.raises(ValueError, match="length"):
        packing.pack(edge_docs, length=F.col("n_chars"), text_out="t")
    assert packing.pack(no_docs, text_out="t").count() == 0
    assert packing.pack(edge_docs, text_out="t").count() >= edge_docs.count()


@pytest.mark.parametrize("most", [200_000, 0])
def test_record_ids_are_unique(spark, most):
    body = "the same payload " * 20
    rows = [(1, "u", body), (1, "u", body), (2, "u", body), (2, "u", body), (None, "u", body), (None, None, "short"), (3, "u", None), (3, "u", "short"), (4, "a:b", body + "x"), (4, "a:b", body + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_warc(pages, scratch(spark, "warc-test"), max_broadcast=most)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest).collect() if r["page_id"] in ("1", "2")) == [
        ("1", "response", None), ("1", "response", None), ("2", "revisit", "1"), ("2", "revisit", "1")
    ]
    ids, refers = [], []
    for r in manifest.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            for member in warc.read_members(f):
                head = member.split(b"\r\n\r\n")[0].decode().split("\r\n")
                ids += [x.split(": ")[1] for x in head if x.startswith("WARC-Record-ID")]
                refers += [x.split(": ")[1] for x in head if x.startswith("WARC-Refers-To")]
    assert len(ids) == len(rows) == len(set(ids))
    assert set(refers) <= set(ids) and len(set(refers)) == 1 and len(refers) == 3


def test_driver_holds_one_block_of_the_benchmark(spark, some_docs):
    """Ten times the blocks don't need ten times the memory, and give the same hits."""
    docs = some_docs.select("doc_id", "text").limit(20)
    bench = spark.range(4_000).select(F.col("id").cast("string").alias("item_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(12)]).alias("text"))
    bench = bench.union(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.substring("text", 1, 400)))
    got, peak = {}, {}
    for blocks in (1, 10):
        gc.collect()
        tracemalloc.start()
        n, each = decontaminate._blocks(bench, "item_id", "text", 3_300_000 // blocks)
        sizes = [sum(len(t) for _, t in b) for b in each]
        peak[blocks] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= blocks and len(sizes) == n
    assert peak[10] < 0.4 * peak[1]
    for block in (16 << 20, 1_700_000):
        got[block] = sorted((r["doc_id"], r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"], r["hits"]["spans"]) for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect())
    assert got[16 << 20] == got[1_700_000] and any(x[2] for x in got[16 << 20])
