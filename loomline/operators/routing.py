"""Routing of a text to personas: keyword, vector and random gates, and hysteresis."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.sources.scratch import written


def top(scores: dict[str, Column], k: int) -> Column:
    """The k (persona, score) of the greatest scores; equal scores by name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.round(s.cast("double"), 9)).alias("d"), F.lit(p).alias("persona")) for p, s in scores.items()]))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["persona"].alias("persona"), (-x["d"]).alias("score")))


def keyword_scores(t: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """Tokens of t among each persona's keywords. t is best a column, for tokens are
    taken once a persona."""
    tok = T.tokens(F.coalesce(t, F.lit("")))

    def hits(words):
        return F.size(F.filter(tok, lambda x: x.isin(words)))

    return {p: hits(w) for p, w in keywords.items()}


def vector_scores(u: Column, described: dict[str, list[float]]) -> dict[str, Column]:
    """Cosine with each persona's description vector; u is a unit vector."""
    return {p: V.dot(u, V.unit(F.array(*[F.lit(float(x)) for x in v]))) for p, v in described.items()}


def random_scores(key: Column, personas: list[str], seed: int = 0) -> dict[str, Column]:
    """Scores in 0 to 1 from md5, equal in any engine and any run."""

    def one(p):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(p))), 1, 8), 16, 10).cast("double") / float(1 << 32)

    return {p: one(p) for p in personas}


def forced(personas: list[str], known: list[str]) -> Column:
    """Personas asked for by name, each with score 1; an unknown one is an error."""
    if unknown := [p for p in personas if p not in known]:
        raise ValueError(f"unknown persona: {', '.join(unknown)}")
    return F.array(*[F.struct(F.lit(p).alias("persona"), F.lit(1.0).alias("score")) for p in personas])


def hysteresis(df: DataFrame, group: str, order: str, scores: dict[str, Column], margin: float = 0.05, segment: int = 4096) -> DataFrame:
    """(group, order, persona): the persona in force stays unless another's score is above
    its own by the margin; the first row takes the best one. Null scores count as 0, a null
    group is a group, and rows of equal order go by their scores.

    A turn is a map from the persona in force before it to the one after it, and maps compose. So
    turns are sorted into ranges and cut into segments of at most `segment`; segments are composed,
    the states before them follow from the composed maps (cut into segments again where a group
    has more than `segment` of them), and each segment is replayed from its own. No row, list or
    task holds a group.
    """
    names = list(scores)
    s = F.array(*[F.round(F.coalesce(x.cast("double"), F.lit(0.0)), 9) for x in scores.values()])
    turns = df.select(F.col(group).alias("g"), F.col(order).alias("o"), s.alias("s"))
    best = F.array_position("s", F.array_max("s")).cast("int")
    beaten = F.transform("s", lambda x: F.round(F.array_max("s") - x, 9) > margin)
    # The map as an array: from no persona (first) and from each.
    to = F.concat(F.array(best), F.transform(beaten, lambda b, i: F.when(b, best).otherwise(i + 1)))
    turns = turns.select("g", "o", "s", F.transform(to, lambda x: x.cast("int")).alias("map"))
    after = _states(turns, ["o", "s"], segment)
    return after.select(F.col("g").alias(group), F.col("o").alias(order), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("after")).alias("persona"))


def _states(rows: DataFrame, order: list[str], segment: int) -> DataFrame:
    """rows (g, the order's columns, map) with `before` and `after`: the states before and after
    each row of its group. Groups begin in state 0."""
    kept = [c for c in rows.columns if c != "map"]
    sorted_ = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    cut = written(sorted_.mapInArrow(_segments(rows.columns.index("g"), rows.columns.index("map"), segment), f"{kinds}, seg long, place int, whole array<int>"), "route-segments")
    whole = cut.where("whole is not null").select("g", F.col("seg").alias("o"), F.col("whole").alias("map"))
    most = whole.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > segment:
        into = _states(whole, ["o"], segment).select(F.col("o").alias("seg"), F.col("before").alias("into"))
    else:
        into = _fold(whole).select("seg", "into")
    replayed = cut.drop("whole").join(into, "seg").sortWithinPartitions("seg", "place")
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return replayed.select(*kept, "seg", "into", "map").mapInArrow(_replay(len(kept)), f"{out}, before int, after int")


def _fold(whole: DataFrame) -> DataFrame:
    """seg and the state into it, where a group has few segments."""
    packed = whole.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("o").alias("seg"), "map"))).alias("t"))
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<seg:bigint,into:int>>").alias("all"))
    step = lambda a, x: F.struct(
        F.element_at(x["map"], a["now"] + 1).alias("now"), F.concat(a["all"], F.array(F.struct(x["seg"].alias("seg"), a["now"].alias("into")))).alias("all")
    )
    return packed.select(F.explode(F.aggregate("t", start, step, lambda a: a["all"])).alias("x")).select("x.*")


def _segments(g_at: int, map_at: int, segment: int):
    """Sorted rows with the number and place of their segment, and on a segment's last row its
    composed map. A segment is of one group and of at most `segment` rows."""

    def run(batches):
        from pyspark import TaskContext

        seg, place, group, composed, last = TaskContext.get().partitionId() << 40, -1, None, None, None
        for batch in batches:
            groups, maps = batch.column(g_at).to_pylist(), batch.column(map_at).to_pylist()
            segs, places, whole = [], [], []
            for g, m in zip(groups, maps, strict=True):
                if place < 0 or g != group or place + 1 >= segment:
                    if place >= 0:
                        (whole if whole else last[2])[-1] = composed
                        seg += 1
                    group, place, composed = g, 0, list(m)
                else:
                    place, composed = place + 1, [m[x] for x in composed]
                segs.append(seg)
                places.append(place)
                whole.append(None)
            if last is not None:
                yield _tagged(*last)
            last = (batch, (segs, places), whole) if segs else last
        if last is not None:
            last[2][-1] = composed
            yield _tagged(*last)

    return run


def _tagged(batch, tags, whole):
    segs, places = tags
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int32()), pa.array(whole, pa.list_(pa.int32()))], names=[*batch.schema.names, "seg", "place", "whole"])


def _replay(kept: int):
    def run(batches):
        seg = now = None
        for batch in batches:
            before, after = [], []
            for own, into, m in zip(batch.column(kept).to_pylist(), batch.column(kept + 1).to_pylist(), batch.column(kept + 2).to_pylist(), strict=True):
                if own != seg:
                    seg, now = own, into
                before.append(now)
                now = m[now]
                after.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*batch.schema.names[:kept], "before", "after"])

    return run
