"""Exact nearest references: blocks with centre and radius, and a bound that skips blocks.

The references are dealt to pivots and packed into blocks of bounded size, in one pass. A query's
product with a reference of a block is at most its product with the centre plus the query's length
times the radius. Every query first meets the block of the greatest bound; its k-th best there
then rules out all blocks whose bound is lower, and it meets the rest. A block's row is followed
by its queries in one sorted partition, so a task holds one block and one batch of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import written

#: Similarities are rounded to 9 places before they are compared; bounds leave room for that.
PLACES, ROOM = 9, 3e-9


def _matrix(column) -> np.ndarray:
    """Rows of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _blocks(right: DataFrame, pivots: np.ndarray, block_rows: int, k: int) -> DataFrame:
    """block, g, centre, radius, refs (ids), packed (the vectors, as bytes): one pass over `right`.
    Of a block's references of one vector the first k are kept, for no more can be among the best."""
    spark, kind = right.sparkSession, right.schema["ref_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(pivots)

    def nearest_pivot(batches):
        for batch in batches:
            x, p = _matrix(batch.column(2)), shared.value
            at = (2 * x @ p.T - (p * p).sum(1)).argmax(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["g", "ref_id", "ru", "pivot"])

    dealt = written(right.select("g", "ref_id", "ru").mapInArrow(nearest_pivot, f"g string, ref_id {kind}, ru array<double>, pivot int"), "nearest-dealt")
    parts = dealt.groupBy("g", "pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    cut = dealt.join(parts, ["g", "pivot"]).withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ref_id")
        x = _matrix(rows["ru"])
        _, kind = np.unique(x, axis=0, return_inverse=True)
        seen = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.diff(kind[seen], prepend=-1))
        place = np.arange(len(seen)) - np.repeat(starts, np.diff([*starts, len(seen)]))
        few = np.sort(seen[place < k])
        x, rows = x[few], rows.take(pa.array(few))
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        g = rows["g"][0].as_py()
        block = f"{rows['pivot'][0]} {rows['part'][0]} {g}"
        refs = pa.ListArray.from_arrays([0, len(x)], rows["ref_id"].combine_chunks())
        return pa.table({"block": [block], "g": [g], "centre": [centre.tolist()], "radius": [radius], "refs": refs, "packed": pa.array([x.tobytes()], pa.binary())})

    return cut.groupBy("g", "pivot", "part").applyInArrow(pack, f"block string, g string, centre array<double>, radius double, refs array<{kind}>, packed binary")


def _meet(asked: DataFrame, blocks: DataFrame, k: int, queries_a_task: int) -> DataFrame:
    """id, ref_id, similarity, met: the k best of each (id, u, block) in its block; met is the
    block's size on the first of them. Blocks that many ask are copied to several partitions."""
    id_kind, ref_kind = asked.schema["id"].dataType.simpleString(), blocks.schema["refs"].dataType.elementType.simpleString()
    load = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / queries_a_task).cast("int").alias("salts"))
    wanted = blocks.join(load, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    held = wanted.select("block", "salt", F.lit(0).alias("kind"), none(id_kind).alias("id"), none("array<double>").alias("u"), "refs", "packed")
    salted = asked.join(load, "block").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    rows = held.unionByName(salted.select("block", "salt", F.lit(1).alias("kind"), "id", "u", none(f"array<{ref_kind}>").alias("refs"), none("binary").alias("packed")))
    ranged = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches):
        refs = x = None
        for batch in batches:
            kinds, n, start = batch.column(2).to_numpy(), len(batch), 0
            while start < n:
                if kinds[start] == 0:
                    refs = batch.column(5)[start].values
                    x = np.frombuffer(batch.column(6)[start].as_py(), np.float64).reshape(len(refs), -1)
                    start += 1
                    continue
                to = start + 1
                while to < n and kinds[to] == 1:
                    to += 1
                for a in range(start, to, 1024):
                    some = batch.slice(a, min(1024, to - a))
                    yield _best(some.column(3), _matrix(some.column(4)), refs, x, k)
                start = to

    return ranged.mapInArrow(run, f"id {id_kind}, ref_id {ref_kind}, similarity double, met long")


def _best(ids, u: np.ndarray, refs, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query; a block's references stand in the order of their ids."""
    sims = np.round(u @ x.T, PLACES)
    keep = np.ones(sims.shape, bool)
    if len(refs) > k:
        least = np.partition(sims, len(refs) - k, axis=1)[:, len(refs) - k, None]
        above, tied = sims > least, sims == least
        keep = above | (tied & (tied.cumsum(1) <= k - above.sum(1, keepdims=True)))
    row, col = np.nonzero(keep)
    met = np.zeros(len(row), np.int64)
    met[np.flatnonzero(np.diff(row, prepend=-1))] = len(refs)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), refs.take(pa.array(col)), pa.array(sims[row, col]), pa.array(met)], names=["id", "ref_id", "similarity", "met"])


def search(left: DataFrame, right: DataFrame, k: int, by: bool = False, block_rows: int = 2_000, pivots: int = 256, max_blocks: int = 20_000, queries_a_task: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(neighbours, work). neighbours: id, rank, ref_id, similarity of the k rows of `right`
    (ref_id, ru) of the greatest dot product with each of `left` (id, u); equal ones by ref_id.
    work: one row, the pairs that were computed and the pairs there are.

    by: both sides have a string column g, and only rows of one g meet (a null meets none).
    Vectors of both sides have one dimension; null vectors are left out. `left` ids are unique.
    Fewer than k references give fewer rows, none give none. Blocks hold about block_rows
    references, or more where max_blocks of them wouldn't do, and a block has one g: what goes to
    every task, centre and radius of each block, has the bound of max_blocks and the g's times the
    pivots. Pivots, one for block_rows references and at most `pivots`, are those of the least hash.
    """
    spark = left.sparkSession
    g = F.col("g") if by else F.lit("")
    right = right.where("ru is not null").select(g.alias("g"), "ref_id", F.col("ru").cast("array<double>").alias("ru")).where("g is not null")
    right = written(right, "nearest-right")
    left = left.where("u is not null").select("id", F.col("u").cast("array<double>").alias("u"), g.alias("g")).where("g is not null")
    left = written(left, "nearest-left")
    rows = right.count()
    first = right.orderBy(F.xxhash64("ref_id"), "ref_id").limit(min(pivots, -(-rows // block_rows))).collect() if rows else []
    shape = f"id {left.schema['id'].dataType.simpleString()}, rank int, ref_id {right.schema['ref_id'].dataType.simpleString()}, similarity double"
    if not first:
        return spark.createDataFrame([], shape), spark.createDataFrame([(0, 0)], "pairs long, of long")
    blocks = written(_blocks(right, np.array([r["ru"] for r in first], float), max(block_rows, -(-rows // max_blocks)), k), "nearest-blocks")
    known = blocks.select("block", "g", "centre", "radius", F.size("refs").alias("n")).orderBy("block").collect()
    codes = {x: i for i, x in enumerate(sorted({r["g"] for r in known}))}
    # Any so many blocks of one g hold k references: a query meets those of the greatest bounds first.
    enough = max(min(len(v), 1 + int(np.searchsorted(np.cumsum(sorted(v)), k))) for v in _by_g(known).values())
    shared = spark.sparkContext.broadcast(
        (np.array([r["block"] for r in known], object), np.array([r["centre"] for r in known]), np.array([r["radius"] for r in known]), np.array([codes[r["g"]] for r in known]), codes)
    )

    def bounds(u: np.ndarray, gs: list) -> np.ndarray:
        """Most that a query's product with a block's references can be; blocks of another g: -inf."""
        _, centre, radius, of, codes = shared.value
        own = np.array([codes.get(x, -1) for x in gs])
        return np.where(own[:, None] == of[None], u @ centre.T + np.sqrt((u * u).sum(1))[:, None] * radius, -np.inf)

    def probed(bound: np.ndarray) -> np.ndarray:
        return np.argpartition(-bound, enough - 1, axis=1)[:, :enough] if enough < bound.shape[1] else np.tile(np.arange(bound.shape[1]), (len(bound), 1))

    id_kind = left.schema["id"].dataType.simpleString()

    def asking(choose):
        """Rows (id, u, g, ...) to (id, u, block) of the blocks that choose() marks."""

        def run(batches):
            for batch in batches:
                u, gs, names = _matrix(batch.column(1)), batch.column(2).to_pylist(), shared.value[0]
                for a in range(0, len(u), 256):
                    bound = bounds(u[a : a + 256], gs[a : a + 256])
                    row, col = np.nonzero(choose(bound, batch.slice(a, 256)) & np.isfinite(bound))
                    for b in range(0, len(row), 4096):
                        at = pa.array(row[b : b + 4096] + a)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(names[col[b : b + 4096]], pa.string())], names=["id", "u", "block"])

        return run

    def best_first(bound, _):
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, probed(bound), True, axis=1)
        return out

    def rest(bound, batch):
        low = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        return (bound >= low[:, None] - ROOM) & ~best_first(bound, None)

    kinds = f"id {id_kind}, u array<double>, block string"
    asked = written(left.mapInArrow(asking(best_first), kinds), "nearest-asked")
    found = written(_meet(asked, blocks, k, queries_a_task), "nearest-first")
    # The k-th best so far.
    kth = found.groupBy("id").agg(F.try_element_at(F.sort_array(F.collect_list("similarity"), asc=False), F.lit(k)).alias("least"))
    more = left.join(kth, "id", "left").select("id", "u", "g", F.col("least").cast("double").alias("least")).mapInArrow(asking(rest), kinds)
    every = written(found.unionByName(_meet(written(more, "nearest-more"), blocks, k, queries_a_task)), "nearest-found")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "ref_id")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "ref_id", "similarity")
    of = left.groupBy("g").agg(F.count(F.lit(1)).alias("a")).join(right.groupBy("g").agg(F.count(F.lit(1)).alias("b")), "g").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("of"))
    return best, every.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("pairs")).crossJoin(of)  # a row each


def _by_g(known) -> dict:
    out: dict = {}
    for r in known:
        out.setdefault(r["g"], []).append(r["n"])
    return out
