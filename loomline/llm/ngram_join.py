"""N-gram Jaccard join: exact, with signature trees inside blocks.

1. Copies of a word sequence form a class; classes are joined, not rows.
2. Blocks. Sets within the threshold differ in at most d tokens, where d follows from the
   size range they share. A range's token universe is cut into m = d + 1 + 2s segments by
   hash, so two similar sets agree on at least 1 + 2s whole segments; each set leaves out
   its s segments of fewest tokens, and one common segment still remains. Sets that agree
   on a segment come into one block (connected components): no similar pair is parted.
   (Below 88 percent, larger sets are blocked by min-hash bands instead; a pair at the
   threshold is then parted with probability 1e-11, about that of a hash collision.)
3. In each block signature trees find the links; large blocks are cut into tiles by size and
   hash, and all pairs of tiles whose sizes can be similar are joined.
4. Components of the links give each row its group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, lean, materialise, table, tune, utf8
from .components import components
from .signature_tree import join

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """ASCII white space ends words; A-Z are lower-cased, all other bytes kept."""
    return text.lower().split()


class Shingler:
    """Sorted distinct 64-bit hashes of a word list's shingles of k words."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        of, k = self.of, self.k
        if not ws:
            return np.zeros(0, np.uint64)
        if len(ws) < k:  # the whole sequence as one
            return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 1)], np.uint64)
        if len(of) > 150_000:
            of.clear()
        h = []
        for w in ws:
            x = of.get(w)
            if x is None:
                x = of[w] = xxhash.xxh64_intdigest(w)
            h.append(x)
        a = np.array(h, np.uint64)
        n = len(a) - k + 1
        s = np.zeros(n, np.uint64)
        for j in range(k):  # order matters: each place has an odd factor of its own
            s = mix(s * _P[j % 5] + a[j : n + j])
        return np.unique(s)


def ranges(percent: int) -> Iterator[tuple[int, int, int]]:
    """Size ranges [low, high], with the most tokens in which two similar sets, the larger
    in the range, can differ."""
    low = 1
    while True:
        high = max(low, math.floor(low * 1.4) - 1)
        yield low, high, 2 * high * (100 - percent) // (100 + percent)
        low = high + 1


class Segments:
    """Keys of the segments that a set is blocked by."""

    def __init__(self, percent: int):
        self.percent, self.table, self.more = percent, [], ranges(percent)
        self.spare = 0.03 if percent >= 88 else 0.1

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n, out = len(tokens), []
        if not n:
            return np.zeros(0, np.uint64)
        # The larger set of a pair has from n to 100 n / percent tokens.
        while not self.table or self.table[-1][1] * self.percent < 100 * n:
            self.table.append(next(self.more))
        for c, (low, high, d) in enumerate(self.table):
            if high < n:
                continue
            if low * self.percent > 100 * n:
                break
            s = math.ceil(self.spare * (d + 1)) if d else 0
            m = d + 1 + 2 * s
            at = (((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # ascends, as the tokens do
            count = np.bincount(at, minlength=m)
            full = np.flatnonzero(count)
            total = np.zeros(m, np.uint64)
            total[full] = np.add.reduceat(mix(tokens), np.concatenate([[0], np.cumsum(count[full])[:-1]]))
            kept = np.argsort(count, kind="stable")[s:] if s else np.arange(m)
            some = kept[count[kept] > 0]
            out.append(mix(total[some] ^ mix(some.astype(np.uint64) * _P[1] + np.uint64((c + 1) * int(_P[0]) % 2**64) + count[some].astype(np.uint64) * _P[2])))
            if len(full) <= d:
                # All that two sets agree on can be empty segments only if both have more than s of
                # these (so that no other is left out) and differ in every other: then no more
                # than d are full. Such sets go by their tokens, of which they share some.
                out.append(mix(tokens ^ mix(np.array([c + 1], np.uint64) * _P[3])))
        return np.concatenate(out)


class Bands:
    """Keys of min-hash bands: a pair at the threshold shares none with probability 1e-11.

    r minima make a key; r is such that a pair at the threshold agrees on three keys in
    ten, so that texts with only a passage in common seldom agree on any.
    """

    def __init__(self, percent: int, miss: float = 1e-11, seed: int = 11):
        p = percent / 100
        self.r = max(1, round(math.log(0.3) / math.log(p)))
        self.b = math.ceil(math.log(miss) / math.log(1 - p**self.r))
        rng = np.random.default_rng(seed)
        self.flip, self.times = rng.integers(0, 2**64 - 1, (2, self.r * self.b, 1), np.uint64)
        self.times |= np.uint64(1)
        self.band = mix(np.arange(1, self.b + 1, dtype=np.uint64) * _P[4])

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        least = np.full(self.r * self.b, 2**64 - 1, np.uint64)
        for k in range(0, len(tokens), 1024):
            x = tokens[None, k : k + 1024] ^ self.flip
            x *= self.times
            np.minimum(least, x.min(axis=1), out=least)
        key = self.band
        for part in least.reshape(self.b, self.r).T:
            key = mix(key * _P[2] ^ part)
        return key


class Keys:
    """What a set is blocked by: exact segments, or for larger sets bands.

    Where similar sets may differ in so many tokens that segments get small (below 88
    percent), passages shared by many texts would join most of them into one block; so
    pairs whose larger set has more than SMALL tokens are blocked by bands there.
    """

    SMALL = 40

    def __init__(self, percent: int):
        self.percent, self.segments = percent, Segments(percent)
        self.bands = Bands(percent) if percent < 88 else None

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if self.bands is None or n == 0:
            return self.segments(tokens)
        parts = [self.segments(tokens)] if n <= self.SMALL else []
        if 100 * n >= self.percent * self.SMALL:
            parts.append(self.bands(tokens))
        return np.concatenate(parts)


def _key(ws: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(ws), digest_size=16).digest()


def keyed(docs: DataFrame, text_col: str, k: int) -> tuple[DataFrame, str, str]:
    """`docs` with a key of the word sequence (null if it has no words) and the set size,
    and the names of these two columns, which no column of `docs` has."""
    key_name, n_name, text = (fresh(docs, f"_ngram_{x}") for x in ("key", "n", "text"))
    rows = docs.withColumn(text, utf8(F.col(text_col)))
    schema = docs.withColumns({key_name: F.lit(b""), n_name: F.lit(0).cast("long")}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        shingle = Shingler(k)
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(batch.num_columns - 1):
                ws = words(t.as_py())
                keys.append(_key(ws) if ws else None)
                sizes.append(len(shingle(ws)))
            columns = [*batch.columns[:-1], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], key_name, n_name])

    return rows.mapInArrow(lean(run), schema), key_name, n_name


def _blocks(docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """(node, label): short ids of the classes that share a segment with another, by block."""

    def run(batches):
        shingle, of_set = Shingler(k), Keys(percent)
        seen: set[bytes] = set()
        for batch in batches:
            segs, ids = [], []
            for t in batch.column(0):
                ws = words(t.as_py())
                key = _key(ws)
                if not ws or key in seen:  # a copy, as far as this task remembers
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                own = of_set(shingle(ws))
                segs.append(own)
                ids.append(np.full(len(own), int.from_bytes(key[:8], "big", signed=True), np.int64))
                if sum(map(len, segs[-1:])) and len(segs) >= 200:
                    yield _pairs(segs, ids)
                    segs, ids = [], []
            if segs:
                yield _pairs(segs, ids)

    def _pairs(segs, ids):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(segs).view(np.int64)), pa.array(np.concatenate(ids))], names=["seg", "id"])

    rows = materialise(docs.select(utf8(F.col(text_col)).alias("t")).mapInArrow(lean(run), "seg long, id long"), "ngram-segments")
    # A segment's least id is a partial aggregate; joined back, a hot segment's rows stand on the
    # side that adaptive execution splits. Few segments have two ids, so few rows are shuffled.
    hubs = rows.groupBy("seg").agg(F.min("id").alias("b"), F.max("id").alias("_max")).where("b <> _max").select("seg", "b")
    hubs = materialise(hubs, "ngram-hubs")
    edges = _among(rows, hubs, "seg").join(hubs, "seg").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    found = components(edges, "ngram-blocks")
    discard(rows)
    discard(hubs)
    return found


BITS = 27


def _bitmap(some: DataFrame, place):
    """Broadcast bitmap of fixed size (2^BITS bits, 16 MB) of places from 0 to 2^BITS - 1."""
    at = some.select(place.alias("h"))
    got = at.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return some.sparkSession.sparkContext.broadcast(bitmap)


def _among(rows: DataFrame, some: DataFrame, col: str) -> DataFrame:
    """`rows` without most of those whose `col` isn't in that of `some`; none that is goes.

    A bitmap of fixed size is broadcast; where `some` is so large that it fills up,
    fewer rows go, and the join that follows has more to do.
    """
    place = F.pmod(F.xxhash64(F.lit(1), col), F.lit(1 << BITS))
    shared = _bitmap(some, place)

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy()
            hit = (bitmap[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)
            part = batch.filter(pa.array(hit.astype(bool)))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])

    return rows.withColumn("_h", place).mapInArrow(lean(run), rows.schema)


def class_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int, tile_tokens: int, every: bool = False) -> DataFrame:
    """Links (a, b) between class keys: those that connect what all links connect, or every
    one. classes: _key, _rep (an id of the class), _n."""
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, text_col, k, percent), "ngram-block-ids")
    short = F.conv(F.hex(F.substring("_key", 1, 8)), 16, -10).cast("long")
    members = materialise(classes.withColumn("node", short).join(blocks, "node").select("_key", "_rep", "_n", F.col("label").alias("block")), "ngram-members")
    discard(blocks)
    # Tiles of a block, by size and hash, enough for each to hold about tile_tokens tokens. Sets of
    # sizes g and h, in steps of the threshold, can be similar only if g and h are neighbours.
    size = F.floor(F.log("_n") / F.log(F.lit(100 / percent * (1 + 1e-6)))).cast("int")  # steps a little wider than the threshold
    members = members.withColumn("g", size)
    tiles = members.groupBy("block", "g").agg(F.ceil(F.sum("_n") / F.lit(tile_tokens)).cast("int").alias("tiles"))
    own = tiles.select("block", "g", "tiles", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)).alias("h"))
    others = own.join(tiles.select("block", F.col("g").alias("h"), F.col("tiles").alias("_t")), ["block", "h"])
    others = others.groupBy("block", "g", "tiles").agg(F.collect_list(F.struct("h", "_t")).alias("others"))  # three at most
    members = members.join(others, ["block", "g"])
    place = lambda g, t: g.cast("long") * F.lit(1 << 32) + t
    members = members.withColumn("tile", place(F.col("g"), F.pmod(F.xxhash64("_key"), F.col("tiles"))))
    other = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["_t"] - 1), lambda t: place(o["h"], t))))
    members = members.select("_key", "_rep", "block", "tile", other.alias("others"))
    rows = docs.select(F.col(id_col).alias("_id"), utf8(F.col(text_col)).alias("_t"))
    shared = _bitmap(members, F.shiftright(F.conv(F.hex(F.substring("_key", 1, 4)), 16, 10).cast("long"), 5))  # the key's first 27 bits
    id_kind = rows.schema["_id"].dataType.simpleString()

    def held(batches):  # texts of no block aren't shuffled
        node = shared.value
        for batch in batches:
            keep, keys = [], []
            for i, t in enumerate(batch.column(1)):
                key = _key(words(t.as_py()))
                h = int.from_bytes(key[:4], "big") >> 5
                if node[h >> 6] >> np.uint64(h & 63) & np.uint64(1):
                    keep.append(i)
                    keys.append(key)
            part = batch.take(pa.array(keep, pa.int64()))
            if keep:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), part.column(1)], names=["_id", "_key", "_t"])

    rows = rows.mapInArrow(lean(held), f"_id {id_kind}, _key binary, _t binary")
    rows = rows.join(members, (rows["_key"] == members["_key"]) & rows["_id"].eqNullSafe(members["_rep"])).select(rows["_key"], "block", "tile", "others", "_t")

    def shingled(batches):
        shingle = Shingler(k)
        for batch in batches:
            sets = [shingle(words(t.as_py())).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.list_(pa.int64()))], names=["_key", "block", "tile", "others", "tokens"])

    sets = rows.mapInArrow(lean(shingled), "_key binary, block long, tile long, others array<long>, tokens array<long>")
    # Each tile meets each tile of its block that can hold similar sets, itself included.
    dealt = sets.withColumn("other", F.explode("others")).select("_key", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "tokens")
    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")

    def joined(batches):
        group, keys, sets, sides = None, [], [], []

        def done():
            place: dict[bytes, int] = {}
            for x, key in enumerate(keys):
                place.setdefault(key, x)
            own = sorted(place.values())
            part = [sets[x] for x in own]
            side = [sides[x] for x in own]
            if group[1] == group[2]:
                found = join(part, percent, every=every)
            else:
                found = join(part, percent, [x for x, s in enumerate(side) if s == group[1]], [x for x, s in enumerate(side) if s == group[2]], every)
            return [(keys[own[a]], keys[own[b]]) for a, b in found]

        for batch in batches:
            links = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            tokens = batch.column(5)
            for x, (key, block, i, j, tile) in enumerate(zip(*columns, strict=True)):
                if group != (block, i, j):
                    if keys:
                        links += done()
                    group, keys, sets, sides = (block, i, j), [], [], []
                keys.append(key)
                sets.append(tokens[x].values.to_numpy(zero_copy_only=False).view(np.uint64))
                sides.append(tile)
            if links:
                yield _links(links)
        if keys and (links := done()):
            yield _links(links)

    def _links(links):
        a, b = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    out = materialise(dealt.mapInArrow(lean(joined), "a binary, b binary"), "ngram-links")
    tune(spark)
    return out


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    tile_tokens: int = 2_000_000,
    links: bool = False,
) -> DataFrame:
    """Groups of rows linked by 100 * intersection >= percent * union of k-word shingles.

    One row per input row: id_col, n_shingles, component_id (the least id reachable by
    links, its own included), kept (one row of each group: the one of that id). Words are
    runs without ASCII white space, A-Z lower-cased; fewer than k words are one shingle.
    Shingles are compared as 64-bit hashes, word sequences as 128-bit ones.

    links: n_links is added, the number of other rows that a row is linked with, copies of its
    own text included. All links between different texts are then found, not only as many as
    connect them, which takes time in proportion to their number.

    A text without words has an empty set and links with nothing: its component is its own
    id. Null texts are empty. Null ids take part, but are no component's id unless all of
    it are null. Of rows tied on a component's id, those of its least key are kept. An
    empty table gives no rows; other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    tune(docs.sparkSession)
    rows, key, n = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")), "_x", k)
    rows = materialise(rows.select("_id", F.col(key).alias("_key"), F.col(n).alias("_n")), "ngram-keys")
    classes = rows.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("_rep"), F.first("_n").alias("_n"))
    classes = materialise(classes, "ngram-classes")
    found = class_links(docs, classes, id_col, text_col, k, percent, tile_tokens, links)
    groups = materialise(components(found, "ngram-components"), "ngram-groups")
    member = classes.join(groups, F.col("_key") == F.col("node"), "left").select("_key", "_rep", F.coalesce("label", "_key").alias("_label"))
    least = member.groupBy("_label").agg(F.min("_rep").alias("_least"))
    # The class that stays: of the group's least id, and of the least key among those.
    stays = member.join(least, "_label").where(F.col("_rep").eqNullSafe(F.col("_least"))).groupBy("_label").agg(F.min("_key").alias("_stays"))
    by_class = member.join(least, "_label").join(stays, "_label").select("_key", "_least", (F.col("_key") == F.col("_stays")).alias("_own"))
    out = rows.where("_key is not null").join(by_class, "_key")
    count = []
    if links:
        copies = rows.where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"))
        both = found.union(found.select("b", "a")).join(copies.select(F.col("_key").alias("b"), "_copies"), "b")
        linked = copies.join(both.groupBy(F.col("a").alias("_key")).agg(F.sum("_copies").alias("_linked")), "_key", "left")
        out = out.join(linked.select("_key", (F.col("_copies") - 1 + F.coalesce("_linked", F.lit(0))).alias("_links")), "_key")
        count = [F.col("_links").alias("n_links")]
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.col("_least").alias("component_id"),
        (F.col("_own") & F.col("_id").eqNullSafe(F.col("_least"))).alias("kept"),
        "_key",
        *count,
    ).union(rows.where("_key is null").select("_id", "_n", "_id", F.lit(True), "_key", *[F.lit(0).cast("long") for _ in count]))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that jaccard_groups keeps, with the columns of `docs`."""
    own, key, _ = keyed(docs, text_col, k)
    gone = jaccard_groups(docs, id_col, text_col, k, percent).where("not kept")
    gone_id, gone_key = fresh(own, "_gone_id"), fresh(own, "_gone_key")
    gone = materialise(gone.select(F.col(id_col).alias(gone_id), F.col("_key").alias(gone_key)).distinct(), "ngram-gone")
    out = own.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    return out.select(*[F.col(c) for c in docs.columns])


def op2_ngram_join(spark, sf_dir):
    """Groups of similar texts of `documents`; edge cases as jaccard_groups() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node)
SELECT doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.c AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY 1) AS c ON c.node = doc_id
"""
