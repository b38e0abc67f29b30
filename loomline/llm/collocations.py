"""Phrase collocations: frequent phrases of two to five words by the score of their weakest cut.

1. Words are counted by language; frequent ones get numbers, and the corpus is written as numbers.
2. Windows of each length are counted by hash bin. A window is a candidate if its bin and those of
   all windows inside it reach the least count: a superset of the frequent phrases (Apriori).
3. The distinct candidates get slots of a minimal perfect hash that stores their keys. Mappers
   look windows up, count slots with bincount, and the arrays are summed up a tree.
4. Each frequent phrase reads the counts of the two sides of every cut by slot.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import perfect_hash
from .common import discard, lean, materialise, table, tune

LONGEST = 5
#: Sides of cuts: words before the cut, and 0 for the side before it, 1 for that after it.
CUTS = [(k, side) for k in range(1, LONGEST) for side in (0, 1)]
#: A-Z become a-z, ends of pieces a byte that UTF-8 doesn't have; blanks and tabs stay.
END = b"\xff"
FOLD = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
GAP = re.compile(rb"[ \t\xff]")
SLICE = 1 << 20
#: Bins (and slots) a row of partial counts.
CHUNK = 1 << 14
#: Arrays summed in one group of the tree.
FAN = 64
#: Windows a mapper holds before it sums them up.
PENDING = 3_000_000


def tokens(texts: list[bytes]):
    """Lists of words of texts, pieces and texts parted by END, a bounded slice at a time."""
    folded = END.join(texts).translate(FOLD)
    at = 0
    while at < len(folded):
        cut = GAP.search(folded, at + SLICE) if len(folded) - at > SLICE else None
        to = cut.start() if cut else len(folded)
        yield folded[at:to].replace(END, b" \xff ").split()
        at = to


def by_lang(batch):
    """(lang, texts) of a batch of lang, text."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        groups.setdefault(lang, []).append(text.as_py())
    return groups.items()


def word_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """lang, word (bytes; null: all words of the language), c. Rows: lang, text (bytes)."""

    def run(batches):
        held: dict[str, Counter] = {}

        def flush():
            out = [(lang, w, c) for lang, of in held.items() for w, c in [*of.items(), (None, of.total())] if c]
            held.clear()
            lang, word, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(c, pa.int64())], names=["lang", "word", "c"])

        for batch in batches:
            for lang, texts in by_lang(batch):
                own = held.setdefault(lang, Counter())
                for part in tokens(texts):
                    own.update(part)
                own.pop(END, None)
            if sum(map(len, held.values())) > most:
                yield flush()
        yield flush()

    return rows.mapInArrow(lean(run), "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def word_blocks(words: DataFrame, block_bytes: int):
    """(first number, [(lang, word, c, n)]) of each block of about block_bytes, one at a time on
    the driver; a word's number is its block's first one plus its place."""
    size = words.agg(F.coalesce(F.sum(F.length("word") + F.length("lang") + 24), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    block, first = F.pmod(F.xxhash64("lang", "word"), F.lit(n)), 1
    for k in range(n):
        rows = [(r["lang"], bytes(r["word"]), r["c"], r["n"]) for r in words.where(block == k).orderBy("lang", "word").collect()]
        yield first, rows
        first += len(rows)
    if first > 2**31 - 1:
        raise ValueError("more frequent words than 31-bit numbers")


def numbered(rows: DataFrame, words: DataFrame, block_bytes: int) -> DataFrame:
    """The corpus as numbers of frequent words: `ids`, int32 arrays as bytes, 0 at ends of pieces
    and in place of rarer words. Above one block of words, ids are filled in a written pass each."""
    out = rows.select("lang", "text", F.lit(None).cast("binary").alias("ids"))
    blocks = flagged(word_blocks(words, block_bytes))
    for k, (last, (first, found)) in enumerate(blocks):
        shared = rows.sparkSession.sparkContext.broadcast((first, found))

        def run(batches, shared=shared, last=last):
            first, found = shared.value
            numbers: dict[str, dict[bytes, int]] = {}
            for i, (lang, word, _, _) in enumerate(found, first):
                numbers.setdefault(lang, {})[word] = i
            for batch in batches:
                yield _number(batch, numbers, last)

        schema = "lang string, text binary, ids binary"
        out = materialise(out.mapInArrow(lean(run), schema), f"collocation-ids-{k}")
        shared.unpersist()
    return out.select("ids")


def flagged(items):
    """(is last, item) of an iterator."""
    items = iter(items)
    for item in items:
        for after in items:
            yield False, item
            item = after
        yield True, item


def _number(batch, numbers: dict, last: bool):
    """Ids of a batch: a row a text until the last block, then a row a language, condensed."""
    langs, texts, before, out = batch.column(0).to_pylist(), batch.column(1), batch.column(2), {"lang": [], "text": [], "ids": []}

    def of(lang, some):
        get, parts = numbers.get(lang, {}).get, [np.zeros(1, np.int32)]
        for part in tokens(some):
            parts.append(np.fromiter(map(get, part, itertools.repeat(0)), np.int32, len(part)))
        return np.concatenate(parts)

    if last and before.null_count == len(before):
        for lang, some in by_lang(batch):
            out["ids"].append(condensed(of(lang, some)).tobytes())
            out["lang"].append(None)
            out["text"].append(None)
    else:
        for lang, text, old in zip(langs, texts, before, strict=True):
            ids = of(lang, [text.as_py()])
            if old.is_valid:
                ids = np.maximum(ids, np.frombuffer(old.as_py(), np.int32))
            out["ids"].append((condensed(ids) if last else ids).tobytes())
            out["lang"].append(lang)
            out["text"].append(None if last else text.as_py())
    return pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["text"], pa.binary()), pa.array(out["ids"], pa.binary())], names=list(out))


def condensed(ids: np.ndarray) -> np.ndarray:
    """Without numbers that stand alone and with one 0 between runs and at the end."""
    some = np.concatenate([[False], ids != 0, [False]])
    ids = np.where(some[:-2] | some[2:], ids, 0).astype(np.int32)
    keep = ids != 0
    keep[1:] |= keep[:-1].copy()
    return np.concatenate([ids[keep], np.zeros(1, np.int32)])


def windows(ids: np.ndarray, bits: int, alive=None):
    """(length, starts, bins) of the windows of each length without a 0; with `alive` (a bit a
    bin, by length) only of those whose bin, and the bins of all windows inside, are alive."""
    ok, h = ids != 0, perfect_hash.key_hash(ids[:, None], 0)
    for length in range(2, LONGEST + 1):
        if len(ids) < length:
            return
        h = perfect_hash.mix(h[:-1], ids[length - 1 :])
        ok = ok[:-1] & ok[1:]
        at = np.flatnonzero(ok)
        bins = (h[at] >> np.uint64(64 - bits)).astype(np.uint32)
        if alive is not None:
            passes = (alive[length - 2][bins >> 3] >> (bins & 7).astype(np.uint8)) & 1 == 1
            at, bins = at[passes], bins[passes]
            ok = np.zeros(len(ok), bool)
            ok[at] = True
        yield length, at, bins


def _partial(counts: dict):
    """Rows of partial counts: sorted places and counts by level, cut into chunks."""
    task, out = TaskContext.get().partitionId(), {k: [] for k in ("level", "chunk", "task", "places", "counts")}
    for level, (places, n) in counts.items():
        chunks = places // CHUNK
        cuts = np.flatnonzero(np.diff(chunks, prepend=-1))
        for a, b in zip(cuts, np.append(cuts, len(places))[1:], strict=True):
            out["level"].append(level)
            out["chunk"].append(int(chunks[a]))
            out["task"].append(task)
            out["places"].append((places[a:b] % CHUNK).astype(np.uint16).tobytes())
            out["counts"].append(n[a:b].astype(np.uint32).tobytes())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


PARTIAL = "level int, chunk int, task int, places binary, counts binary"


def tree(rows: DataFrame, tasks: int, add) -> DataFrame:
    """Partial rows of a level and chunk brought together by add(tables) -> one row's places and
    counts, FAN tasks' rows a group, until one group is left. A task may have several rows."""

    def join(part: pa.Table) -> pa.Table:
        places, counts = add(part)
        first = part.slice(0, 1)
        return pa.table({"level": first["level"], "chunk": first["chunk"], "task": first["task"], "places": pa.array([places], pa.binary()), "counts": pa.array([counts], pa.binary())})

    while True:
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("level", "chunk", "task").applyInArrow(join, PARTIAL)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return rows


def tree_sum(rows: DataFrame, tasks: int) -> DataFrame:
    """Sums of partial counts by level and chunk: level, chunk, counts (CHUNK int64 as bytes)."""

    def add(part: pa.Table):
        total = np.zeros(CHUNK, np.int64)
        for places, counts in zip(part["places"], part["counts"], strict=True):
            if places.is_valid:
                at, n = np.frombuffer(places.as_buffer(), np.uint16), np.frombuffer(counts.as_buffer(), np.uint32)
                total[at] += n
            else:
                total += np.frombuffer(counts.as_buffer(), np.int64)
        return None, total.tobytes()

    return tree(rows, tasks, add).select("level", "chunk", "counts")


def alive_bins(ids: DataFrame, bits: int, min_count: int) -> list[np.ndarray]:
    """By length (from 2) a bit a bin: whether min_count windows or more fall into it."""

    def run(batches):
        held, size = {k: [] for k in range(2, LONGEST + 1)}, 0

        def flush():
            return _partial({k: np.unique(np.concatenate(v), return_counts=True) for k, v in held.items() if v})

        for batch in batches:
            for raw in batch.column(0):
                for length, _, bins in windows(np.frombuffer(raw.as_buffer(), np.int32), bits):
                    held[length].append(bins)
                    size += len(bins)
                if size > PENDING:
                    yield flush()
                    held, size = {k: [] for k in held}, 0
        yield flush()

    sums = tree_sum(ids.mapInArrow(lean(run), PARTIAL), ids.rdd.getNumPartitions())

    def bitmap(batches):
        for batch in batches:
            packed = [np.packbits(np.frombuffer(c.as_buffer(), np.int64) >= min_count, bitorder="little").tobytes() for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["level", "chunk", "bits"])

    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(2, LONGEST + 1)]
    for r in sums.mapInArrow(bitmap, "level int, chunk int, bits binary").collect():  # 2^bits bits a length in all
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        own = out[r["level"] - 2][r["chunk"] * CHUNK // 8 :][: len(part)]
        own[:] = part[: len(own)]
    return out


def candidates(ids: DataFrame, alive, bits: int) -> DataFrame:
    """The distinct windows that are alive: `key`, their int32 numbers as bytes. Mappers give
    arrays of them, cut by bin, and a tree brings those of all tasks together."""
    cut = max(0, bits - 8)

    def run(batches):
        alive_now, held, size = alive.value, {k: [] for k in range(2, LONGEST + 1)}, 0
        task = TaskContext.get().partitionId()

        def flush():
            out = {k: [] for k in ("level", "chunk", "task", "places", "counts")}
            for length, found in held.items():
                if not found:
                    continue
                keys, bins = np.concatenate([k for k, _ in found]), np.concatenate([b for _, b in found])
                first = distinct(keys)
                first = first[np.argsort(bins[first] >> cut, kind="stable")]
                chunks = bins[first] >> cut
                cuts = np.flatnonzero(np.diff(chunks.astype(np.int64), prepend=-1))
                for a, b in zip(cuts, np.append(cuts, len(first))[1:], strict=True):
                    for name, v in zip(out, (length, int(chunks[a]), task, keys[first[a:b]].tobytes(), None), strict=True):
                        out[name].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), np.int32)
                for length, at, bins in windows(x, bits, alive_now):
                    keys = x[at[:, None] + np.arange(length)]
                    first = distinct(keys)
                    held[length].append((keys[first], bins[first]))
                    size += len(first)
                if size > PENDING // 2:
                    yield flush()
                    held, size = {k: [] for k in held}, 0
        yield flush()

    def unite(part: pa.Table):
        keys = np.frombuffer(b"".join(part["places"].to_pylist()), np.int32).reshape(-1, part["level"][0].as_py())
        return keys[distinct(keys)].tobytes(), None

    def apart(batches):
        for batch in batches:
            for length, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = 4 * length
                yield pa.RecordBatch.from_arrays([pa.array([packed[i : i + size] for i in range(0, len(packed), size)], pa.binary())], names=["key"])

    united = tree(ids.mapInArrow(lean(run), PARTIAL), ids.rdd.getNumPartitions(), unite)
    return united.select("level", "places").mapInArrow(apart, "key binary")


def distinct(keys: np.ndarray) -> np.ndarray:
    """Places of the distinct rows: the first of each hash, and of a hash's different rows all."""
    h = perfect_hash.key_hash(keys, 1)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    other = np.flatnonzero((keys[first[inverse]] != keys).any(axis=1))
    if not len(other):
        return first
    return np.concatenate([first, other[np.unique(keys[other], axis=0, return_index=True)[1]]])


def wide(keys) -> np.ndarray:
    """Keys (bytes) as rows of LONGEST numbers, 0 after their end."""
    out = np.zeros((len(keys), LONGEST), np.int32)
    for i, k in enumerate(keys):
        x = np.frombuffer(k, np.int32)
        out[i, : len(x)] = x
    return out


def counted_phrases(ids: DataFrame, found: DataFrame, alive, bits: int, block_keys: int):
    """By block of about block_keys candidates: (hash, counts by slot), summed over all windows.
    The hash is built in a task; the driver passes on one block's arrays at a time."""
    n = max(1, -(-found.count() // block_keys))
    block, spark = F.pmod(F.xxhash64("key"), F.lit(n)), ids.sparkSession
    tasks = ids.rdd.getNumPartitions()

    def make(part: pa.Table) -> pa.Table:
        return pa.table({"block": part["block"].slice(0, 1), "hash": pa.array([pickle.dumps(perfect_hash.build(wide(part["key"].to_pylist())))], pa.binary())})

    for k in range(n):
        made = found.where(block == k).select(F.lit(k).alias("block"), "key").groupBy("block").applyInArrow(make, "block int, hash binary").first()
        if made is None:
            continue
        table_ = pickle.loads(bytes(made["hash"]))
        shared = spark.sparkContext.broadcast(table_)

        def run(batches, shared=shared):
            hashed, alive_now = shared.value, alive.value
            total = np.zeros(len(hashed["keys"]), np.int64)
            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_buffer(), np.int32)
                    for length, at, _ in windows(x, bits, alive_now):
                        for a in range(0, len(at), 1 << 18):
                            keys = np.zeros((len(at[a : a + (1 << 18)]), LONGEST), np.int32)
                            keys[:, :length] = x[at[a : a + (1 << 18), None] + np.arange(length)]
                            slots = perfect_hash.look_up(hashed, keys)
                            total += np.bincount(slots[slots >= 0], minlength=len(total))
            some = np.flatnonzero(total)
            yield _partial({0: (some, total[some])})

        counts = np.zeros(-(-len(table_["keys"]) // CHUNK) * CHUNK, np.int64)
        for r in tree_sum(ids.mapInArrow(lean(run), PARTIAL), tasks).collect():  # 8 bytes a slot
            counts[r["chunk"] * CHUNK :][:CHUNK] = np.frombuffer(bytes(r["counts"]), np.int64)
        yield table_, counts[: len(table_["keys"])]
        shared.unpersist()




def part_keys(keys: np.ndarray, cut: int, side: int) -> np.ndarray:
    """The numbers before (side 0) or after (side 1) the cut, for rows of more than `cut` words."""
    out = np.zeros_like(keys)
    if side == 0:
        out[:, :cut] = keys[:, :cut]
    else:
        out[:, : LONGEST - cut] = keys[:, cut:]
    out[keys[:, cut] == 0] = 0
    return out


def read_cuts(phrases: DataFrame, shared) -> DataFrame:
    """key, a, cuts with the counts of those sides that the block stores written into `cuts` (an
    int64 for each of CUTS, as bytes)."""

    def run(batches):
        hashed, counts = shared.value
        for batch in batches:
            keys = wide(batch.column(0).to_pylist())
            cuts = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, len(CUTS)).copy()
            for c, (cut, side) in enumerate(CUTS):
                slots = perfect_hash.look_up(hashed, part_keys(keys, cut, side))
                cuts[slots >= 0, c] = counts[slots[slots >= 0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in cuts], pa.binary())], names=["key", "a", "cuts"])

    return phrases.mapInArrow(lean(run), "key binary, a long, cuts binary")


def read_words(phrases: DataFrame, shared) -> DataFrame:
    """key, a, cuts, lang, n, words with what the block of words knows written in."""

    def run(batches):
        first, found = shared.value
        for batch in batches:
            keys, out = wide(batch.column(0).to_pylist()), batch.to_pydict()
            for i, row in enumerate(keys):
                numbers = row[row > 0].tolist()
                known = {j: found[x - first] for j, x in enumerate(numbers) if first <= x < first + len(found)}
                if not known:
                    continue
                spelled = list(out["words"][i] or [None] * len(numbers))
                for j, (lang, word, _, n) in known.items():
                    spelled[j], out["lang"][i], out["n"][i] = word, lang, n
                out["words"][i] = spelled
                cuts = np.frombuffer(out["cuts"][i], np.int64).copy()
                for j, at in ((0, CUTS.index((1, 0))), (len(numbers) - 1, CUTS.index((len(numbers) - 1, 1)))):
                    if j in known:
                        cuts[at] = known[j][2]
                out["cuts"][i] = cuts.tobytes()
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return phrases.mapInArrow(lean(run), "key binary, a long, cuts binary, lang string, n long, words array<binary>")


def scored(phrases: DataFrame) -> DataFrame:
    """key, lang, phrase, a, l, r, n, score: the lowest cut's, the first of those tied. Whole
    numbers of any size, so that no product is rounded."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = {k: [] for k in ("key", "lang", "phrase", "a", "l", "r", "n", "score")}
            for key, a, cuts, lang, n, words in zip(*rows.values(), strict=True):
                of = np.frombuffer(cuts, np.int64).tolist()
                best = min((1000 * a * n // (of[2 * k] * of[2 * k + 1]), k) for k in range(len(words) - 1))
                for name, v in zip(out, (key, lang, b" ".join(words).decode("utf-8", "replace"), a, of[2 * best[1]], of[2 * best[1] + 1], n, best[0]), strict=True):
                    out[name].append(v)
            kinds = (pa.binary(), pa.string(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return phrases.mapInArrow(lean(run), "key binary, lang string, phrase string, a long, l long, r long, n long, score long")


def contained(phrases: DataFrame, share: int) -> DataFrame:
    """key, longer: the largest count among longer phrases that hold the phrase's words in a row,
    of phrases for which that is `share` percent of their own count or more."""
    inside = F.expr(
        "flatten(transform(sequence(2L, length(key) div 4 - 1), k -> transform(sequence(0L, length(key) div 4 - k), s -> substring(key, int(s * 4 + 1), int(k * 4)))))"
    )
    parts = phrases.where(F.length("key") > 8).select(F.explode(inside).alias("key"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
    both = phrases.select("key", "a", F.lit(None).cast("long").alias("longer")).union(parts)
    return both.groupBy("key").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).where(100 * F.col("longer") >= share * F.col("a")).select("key", "longer")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 100,
    share: int = 100,
    top: int | None = 2_000,
    block_keys: int = 1_000_000,
    block_bytes: int = 16 << 20,
    max_bits: int = 28,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best `top` phrases (None: all).

    Words are runs without blank or tab, A-Z lower-cased, in pieces that end at . , ; : ! ? and
    line ends (\\n, \\x0b, \\x0c, \\r). a: occurrences of the phrase (2 to 5 words, min_count or
    more), n: words of the language; l, r and score = floor(1000 a n / (l r)) of the lowest-scoring
    cut, ties to the first. A phrase inside a longer one that has `share` percent of its count goes.
    Order: score and a descending, phrase ascending by bytes.

    Null texts count as empty, a null lang is `und`. Repeated rows count each. Very long texts
    are cut into slices between words, and windows run across them. An empty table, or one
    without frequent phrases, gives no rows; other columns are not read.

    What is broadcast has a bound: 4 * 2^max_bits bits of bins, blocks of block_keys candidates
    and of block_bytes of frequent words. More of these mean more passes over the numbers of the
    corpus; too few bins for it mean more candidates; neither changes the result.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counts = materialise(word_counts(rows).where((F.col("c") >= min_count) | F.col("word").isNull()), "collocation-counts")
    totals = counts.where("word is null").select("lang", F.col("c").alias("n"))
    words = materialise(counts.where("word is not null").join(totals, "lang"), "collocation-words")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(14, min(max_bits, (12 * total // max(1, min_count)).bit_length()))

    ids = numbered(rows, words, block_bytes)
    discard(counts)
    alive = spark.sparkContext.broadcast(alive_bins(ids, bits, min_count))
    found = materialise(candidates(ids, alive, bits), "collocation-candidates")

    parts, stored = [], []
    for hashed, slots in counted_phrases(ids, found, alive, bits, block_keys):
        shared = spark.sparkContext.broadcast((hashed, slots))
        parts.append(materialise(_frequent(found, shared, min_count), "collocation-phrases"))
        stored.append(shared)
    discard(ids)
    discard(found)
    if not parts:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = parts[0]
    for p in parts[1:]:
        phrases = phrases.union(p)

    full = phrases.withColumn("cuts", F.lit(bytes(8 * len(CUTS))))
    for shared in stored:
        full = materialise(read_cuts(full, shared), "collocation-cuts")
    full = full.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<binary>").alias("words"))
    for block in word_blocks(words, block_bytes):
        full = materialise(read_words(full, spark.sparkContext.broadcast(block)), "collocation-cuts")
    kept = scored(full).join(contained(phrases, share), "key", "left_anti")
    return best(kept, top)


def _frequent(found: DataFrame, shared, min_count: int) -> DataFrame:
    """key, a of the block's candidates that are frequent."""

    def run(batches):
        hashed, counts = shared.value
        for batch in batches:
            slots = perfect_hash.look_up(hashed, wide(batch.column(0).to_pylist()))
            a = np.where(slots >= 0, counts[slots], 0)
            some = a >= min_count
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(a[some])], names=["key", "a"])

    return found.mapInArrow(lean(run), "key binary, a long")


def best(rows: DataFrame, top: int | None, parts: int = 64) -> DataFrame:
    """Ranks within each language: first within parts of it, so that no task sorts a language."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    if top is not None:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    """The best 2,000 phrases of each language of `documents`; edge cases as collocations() says."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents
  )
),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM piece, range(1, 6) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, g, count(*) AS a FROM gram GROUP BY lang, k, g HAVING count(*) >= 100),
cand AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k >= 2),
cut AS (
  SELECT lang, c.k, c.g, c.a, j, array_to_string(w[1 : j], ' ') AS lg, array_to_string(w[j + 1 : c.k], ' ') AS rg
  FROM cand c, unnest(range(1, c.k)) AS u(j)
),
sc AS (
  SELECT cut.lang, cut.k, cut.g, cut.a, j, l.a AS l, r.a AS r, n, ((1000::hugeint * cut.a * n) // (l.a::hugeint * r.a))::bigint AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.g = lg AND l.k = j JOIN f r ON r.lang = cut.lang AND r.g = rg AND r.k = cut.k - j
  JOIN total ON total.lang = cut.lang
),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, g ORDER BY score, j) AS o FROM sc) WHERE o = 1),
part AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS g, m AS k, max(a) AS longer
  FROM cand c, range(2, 5) AS s(m), unnest(range(1, c.k - m + 2)) AS u(i) WHERE m < c.k GROUP BY 1, 2, 3
),
kept AS (SELECT low.* FROM low LEFT JOIN part USING (lang, g, k) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank::bigint AS rank, g AS phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score FROM ranked WHERE rank <= 2000
"""
