"""Distinct-n and self-BLEU of groups of texts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.sources.scratch import written

#: Words of a chunk, texts of a chunk, and (chunk, gram) pairs of a shard: what a task holds.
CHUNK_WORDS, CHUNK_TEXTS, SHARD_GRAMS = 500_000, 50_000, 4_000_000


def gram_stats(df: DataFrame, by: list[str], text: str, key: str | None, orders, chunk_words: int = CHUNK_WORDS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """A row for each of df: by, _k, _len (words) and, of each order n, total_n (its n-grams), hit_n
    (of these, how many the text of its group that has most of the gram has too, the text itself
    left out), own_n (those grams that are counted here as distinct ones of the group, so that
    each is counted in one text). Grams don't span texts.

    Texts are packed into chunks. A chunk asks, in arrays cut by ranges of hashes (shards), for its
    distinct (group, gram): 64 bits of hash and the most that one of its texts has. A shard answers
    in the same order the most of any other chunk, and which chunk counts the gram. So a gram
    crosses the network once a chunk, however many texts of it have the gram.
    """
    orders, spark = tuple(sorted(orders)), df.sparkSession
    # Arrow batches bounded by bytes, as the operators of llm have them.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    k = F.lit(0) if key is None else F.col(key)
    tok = F.transform(T.tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w))
    group = F.xxhash64(*[x for c in by for x in (F.col(c).isNull(), F.col(c))]) if by else F.lit(0).cast("long")
    rows = df.select(F.struct(*by, k.alias("_k")).alias("g"), group.alias("h"), tok.alias("w"))
    g = rows.schema["g"].dataType.simpleString()
    chunk, ask, answer, count = _steps(orders, chunk_words)
    chunks = written(rows.mapInArrow(chunk, f"chunk long, g array<{g}>, h binary, size binary, vocabulary binary, code binary, words long"), "gram-chunks")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words * len(orders) // shard_grams))
    asked = chunks.drop("g").mapInArrow(ask(shards), "chunk long, shard int, key binary, most binary")
    answered = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(answer, "chunk long, shard int, other binary")
    got = answered.groupBy("chunk").agg(F.collect_list(F.struct("shard", "other")).alias("a"))
    each = ", ".join(f"total_{n} long, hit_{n} long, own_{n} long" for n in orders)
    out = chunks.join(got, "chunk", "left").mapInArrow(count(shards), f"g {g}, _len long, {each}")
    return out.select(*[F.col("g")[c].alias(c) for c in [*by, "_k"]], *out.columns[1:])


def _steps(orders: tuple[int, ...], chunk_words: int):
    """The functions that run in tasks: they refer to each other, and to nothing of this module."""
    chunk_texts = CHUNK_TEXTS

    def mix(h, w):
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def small(x):
        return x.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * b)).tobytes()

    def large(b, n):
        return np.frombuffer(b, f"<u{len(b) // n}").astype(np.int32) if n else np.zeros(0, np.int32)

    def planes(x):
        return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()

    def joined(b):
        return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()

    def starts(*sorted_columns):
        """Where runs of equal rows begin."""
        if not len(sorted_columns[0]):
            return np.zeros(0, np.int64)
        new = np.ones(len(sorted_columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
        return np.flatnonzero(new)

    def others(c, begin):
        """Of each value the greatest other one of its run, 0 if it has none."""
        if not len(c):
            return c
        sizes = np.diff(np.append(begin, len(c)))
        out = np.repeat(np.maximum.reduceat(c, begin), sizes)
        top = c == out
        alone = np.add.reduceat(top, begin, dtype=np.int32) == 1
        top &= np.repeat(alone, sizes)
        out[top] = np.maximum.reduceat(np.where(top, 0, c), begin)[alone]
        return out

    def trimmed():
        """Freed memory goes back to the system, so that the next task's doesn't come on top."""
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # no such function outside glibc
            pass

    def chunk(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        held, words = [], 0

        def packed():
            nonlocal held, words, made
            g = pa.concat_arrays([b.column(0) for b in held])
            h = np.concatenate([b.column(1).to_numpy() for b in held])
            size = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
            w = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for b in held])
            vocabulary, code = np.unique(w.view(np.uint64), return_inverse=True)
            columns = [pa.array([part + made]), pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), g)]
            columns += [pa.array([x], pa.binary()) for x in (h.tobytes(), size.astype("<u4").tobytes(), vocabulary.tobytes(), small(code))]
            held, words, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([*columns, pa.array([len(w)])], names=["chunk", "g", "h", "size", "vocabulary", "code", "words"])

        for batch in batches:
            ends, start = batch.column(2).offsets.to_numpy(), 0
            while start < len(batch):
                room = chunk_words - words
                n = max(1, int(np.searchsorted(ends, ends[start] + room, "right")) - 1 - start)
                n = min(n, len(batch) - start, chunk_texts)
                if held and ends[start + n] - ends[start] > room:
                    yield packed()
                    continue
                held.append(batch.slice(start, n))
                words, start = words + int(ends[start + n] - ends[start]), start + n
                if words >= chunk_words or sum(map(len, held)) >= chunk_texts:
                    yield packed()
        if held:
            yield packed()

    def grams(row):
        """Of a chunk's grams sorted by hash: the hash of each run of equal (hash, text), the place
        (text, order) and length of the run, and where the runs of equal hashes begin."""
        size = np.frombuffer(row["size"], "<u4").astype(np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        w = vocabulary[large(row["code"], row["words"])] if row["words"] else np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        group = np.frombuffer(row["h"], "<u8")
        h, keys, places = np.full(len(w), 1, np.uint64), [], []
        for n in range(1, orders[-1] + 1):
            if len(w) < n:
                break
            h = mix(h[: len(w) - n + 1], w[n - 1 :])
            if n in orders:
                whole = np.flatnonzero(text[: len(w) - n + 1] == text[n - 1 :])
                of = text[whole]
                keys.append(mix(mix(h[whole], group[of]), np.uint64(n)))
                places.append(of * np.int32(len(orders)) + np.int32(orders.index(n)))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        place = np.concatenate(places) if places else np.zeros(0, np.int32)
        del h, w, text, keys, places
        at = np.argsort(key, kind="stable")
        key, place = key[at], place[at]
        del at
        run = starts(key, place)
        c = np.diff(np.append(run, len(key))).astype(np.int32)
        key, place = key[run], place[run]
        return key, place, c, starts(key), len(size)

    def cuts(key, shards):
        """Where each shard's range of sorted hashes begins, and the end."""
        shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def ask(shards):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    trimmed()
                    key, _, c, begin, _ = grams(row)
                    if not len(key):
                        continue
                    key, most = key[begin], np.maximum.reduceat(c, begin)
                    at = cuts(key, shards)
                    some = [s for s in range(shards) if at[s] < at[s + 1]]
                    for a in range(0, len(some), 256):
                        part = some[a : a + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["chunk"]] * len(part)), pa.array(part, pa.int32())]
                            + [pa.array(x, pa.binary()) for x in ([planes(key[at[s] : at[s + 1]]) for s in part], [small(most[at[s] : at[s + 1]]) for s in part])],
                            names=["chunk", "shard", "key", "most"],
                        )

        return run

    def answer(batches):
        held = []

        def answered():
            sizes = [len(r["key"]) // 8 for r in held]
            key = np.concatenate([joined(r["key"]) for r in held])
            most = np.concatenate([large(r["most"], n) for r, n in zip(held, sizes, strict=True)])
            at = np.argsort(key, kind="stable")
            key, most = key[at], most[at]
            begin = starts(key)
            told = others(most, begin) * 2
            told[begin] += 1  # the first chunk of a gram counts it
            out = np.empty(len(key), np.int32)
            out[at] = told
            del key, most, at, begin, told
            ends = np.cumsum([0, *sizes])
            for a in range(0, len(held), 256):
                part = held[a : a + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["chunk"] for r in part]), pa.array([r["shard"] for r in part], pa.int32()), pa.array([small(out[ends[a + i] : ends[a + i + 1]]) for i in range(len(part))], pa.binary())],
                    names=["chunk", "shard", "other"],
                )

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != held[0]["shard"]:
                    yield from answered()
                    held = []
                    trimmed()
                held.append(row)
        if held:
            yield from answered()

    def count(shards):
        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    trimmed()
                    one = batch.slice(i, 1)
                    row = {c: one.column(c)[0].as_py() for c in one.schema.names if c != "g"}
                    key, place, c, begin, texts = grams(row)
                    other, own = np.zeros(len(begin), np.int32), np.zeros(len(begin), bool)
                    at = cuts(key[begin], shards)
                    for a in row["a"] or []:
                        told = large(a["other"], at[a["shard"] + 1] - at[a["shard"]])
                        other[at[a["shard"]] : at[a["shard"] + 1]], own[at[a["shard"]] : at[a["shard"] + 1]] = told >> 1, told & 1
                    hit = np.minimum(c, np.maximum(others(c, begin), np.repeat(other, np.diff(np.append(begin, len(key))))))
                    tell = lambda p, x: np.bincount(p, x, texts * len(orders)).astype(np.int64).reshape(texts, len(orders))
                    each = [tell(place, c), tell(place, hit), tell(place[begin], own)]
                    size = np.frombuffer(row["size"], "<u4").astype(np.int64)
                    g = one.column("g").flatten()
                    for x in range(0, texts, 10_000):
                        part = slice(x, x + 10_000)
                        yield pa.RecordBatch.from_arrays(
                            [g.slice(x, 10_000), pa.array(size[part]), *[pa.array(t[part, j]) for j in range(len(orders)) for t in each]],
                            names=["g", "_len", *[f"{t}_{n}" for n in orders for t in ("total", "hit", "own")]],
                        )

        return run

    return chunk, ask, answer, count


def distinct_n(df: DataFrame, by: list[str], text: str, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Distinct over all n-grams of each group, 0 if it has none; grams don't span texts."""
    return distinct_of(gram_stats(df, by, text, None, orders), by, orders)


def distinct_of(stats: DataFrame, by: list[str], orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """distinct_n() of the rows of gram_stats()."""
    share = lambda n: F.coalesce(F.sum(f"own_{n}") / F.nullif(F.sum(f"total_{n}"), F.lit(0)), F.lit(0.0)).alias(f"distinct_{n}")
    return stats.groupBy(*by).agg(*[share(n) for n in orders])


def self_bleu(df: DataFrame, by: list[str], text: str, key: str, max_n: int = 4) -> DataFrame:
    """Mean sentence BLEU of each text against the others of its group; 0 for one text. Keys are
    unique in a group.

    The most that any other text has of a gram comes from gram_stats(), so no pairs are formed.
    Zero orders are smoothed by doubling.
    """
    return self_bleu_of(written(gram_stats(df, by, text, key, range(1, max_n + 1)), "grams"), by, max_n)


def self_bleu_of(stats: DataFrame, by: list[str], max_n: int = 4) -> DataFrame:
    """self_bleu() of the rows of gram_stats(), which are read twice."""
    # Closest reference length, ties to the shorter: the neighbours among the group's lengths.
    w = Window.partitionBy(*by).orderBy("_len")
    lengths = stats.groupBy(*by, "_len").agg(F.count(F.lit(1)).alias("_c")).select(*by, "_len", "_c", F.lag("_len").over(w).alias("_low"), F.lead("_len").over(w).alias("_high"))
    near = F.when(F.col("_high").isNull() | (F.col("_len") - F.col("_low") <= F.col("_high") - F.col("_len")), F.col("_low")).otherwise(F.col("_high"))
    ref = lengths.select(*by, "_len", F.when(F.col("_c") > 1, F.col("_len")).otherwise(near).alias("r")).where("r is not null")
    joined = stats.join(ref, [*by, "_len"])
    zeros, logs = F.lit(0), F.lit(0.0)
    for n in range(1, max_n + 1):
        hit, total = F.col(f"hit_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(hit == 0, 1).otherwise(0)
        logs = logs + F.when(hit > 0, F.log(hit / F.greatest(total, F.lit(1)))).otherwise(
            -zeros * F.log(F.lit(2.0)) - F.log(F.when(total == 0, F.greatest(F.col("_len"), F.lit(1))).otherwise(total).cast("double"))
        )
    brevity = F.when(F.col("_len") > F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.greatest(F.col("_len"), F.lit(1))))
    bleu = F.when(F.col("_len") > 0, brevity * F.exp(logs / max_n)).otherwise(F.lit(0.0))
    means = joined.groupBy(*by).agg(F.avg(bleu).alias("self_bleu"))
    return stats.select(*by).distinct().join(means, by, "left").withColumn("self_bleu", F.coalesce("self_bleu", F.lit(0.0)))
