"""Quality, rarity and choice of preference pairs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import vectors as V


def coherence(t: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.25 * T.repetitions(t))


def length_score(n: Column) -> Column:
    return F.when(n <= 100, n / 100).otherwise(100 / F.greatest(n, F.lit(1)))


def quality(t: Column, relevance: Column | None = None) -> Column:
    """0 outside 10 to 400 words; with a relevance 0.5/0.3/0.2, else 0.6/0.4."""
    t = F.coalesce(t, F.lit(""))
    n, c = T.n_words(t), coherence(t)
    value = 0.6 * c + 0.4 * length_score(n) if relevance is None else 0.5 * F.greatest(F.lit(0.0), relevance) + 0.3 * c + 0.2 * length_score(n)
    return F.when((n < 10) | (n > 400), F.lit(0.0)).otherwise(value)


def with_rarity(df: DataFrame, pool: list[str], embedding: str = "embedding") -> DataFrame:
    """1 - mean cosine with the rest of the pool, at least 0; alone: 1."""
    rows = V.with_unit(df, embedding)
    sums = V.group_sums(rows, pool, V.dimension(df, embedding))
    joined = rows.join(sums.select(*pool, "n", "S"), pool)
    rare = F.greatest(F.lit(0.0), 1 - F.coalesce(V.others_mean(F.col("u"), F.col("n"), F.col("S")), F.lit(0.0)))
    return joined.withColumn("rarity", rare).drop("u", "n", "S")


def with_minmax(df: DataFrame, x: str, pool: list[str], out: str = "score") -> DataFrame:
    """x to 0..1 in the pool; a pool of one, or of no range, is all 1. The pool's bounds are
    partial aggregates, joined back."""
    keys = [f"_pool_{k}" for k in range(len(pool))]
    g = df.groupBy(*[F.col(c).alias(k) for c, k in zip(pool, keys, strict=True)]).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.count(F.lit(1)).alias("_size"))
    value = F.when((F.col("_size") < 2) | (F.col("_high") - F.col("_low") < 1e-9), F.lit(1.0)).otherwise((F.col(x) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.join(g, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(pool, keys, strict=True)]).select(*df.columns, value.alias(out))


def with_quality(df: DataFrame, pool: list[str], score_batch: Callable[[str, list[str]], list[float]], prompt: str = "prompt", order: str = "doc_id", text: str = "text", batch_rows: int = 1024, batch_bytes: int = 8 << 20) -> DataFrame:
    """`quality` by an external scorer, asked with a pool's prompt and texts, in order.

    A pool of at most batch_rows rows and batch_bytes of text is asked about once, with all its
    texts; a larger one in slices of so many, each slice in order, by as many tasks as its rows
    need. A task holds one slice. A number of scores other than that of the texts is an error, and
    so is a score that isn't a number. Null texts are asked about as empty. A null in `pool` is a
    pool, and rows of equal order stand in any order. `quality` of the input, if any, is replaced.
    """
    df = df.drop("quality")
    keys = [f"_pool_{k}" for k in range(len(pool))]
    size = df.groupBy(*[F.col(c).alias(k) for c, k in zip(pool, keys, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    large = size.where(F.col("_rows") > batch_rows).drop("_rows").withColumn("_large", F.lit(True))
    marked = df.join(large, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(pool, keys, strict=True)], "left").drop(*keys)
    # Small pools have one key, so that no range cuts them; large ones may be cut anywhere.
    cut = F.when(F.col("_large"), F.col(order))
    ranged = marked.withColumn("_cut", cut).repartitionByRange(*pool, "_cut").sortWithinPartitions(*pool, order).drop("_large", "_cut")
    at = {c: df.columns.index(c) for c in (*pool, prompt, text)}

    def run(batches):
        held, key, rows, size = [], None, 0, 0  # slices of batches, all of one pool

        def scored():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = [t or "" for t in whole.column(at[text]).to_pylist()]
            got = [float(x) for x in score_batch(whole.column(at[prompt])[0].as_py(), texts)]
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} scores for {len(texts)} candidates")
            if any(x != x for x in got):
                raise ValueError("a score that isn't a number")
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(got, pa.float64())], names=[*whole.schema.names, "quality"])

        for batch in batches:
            of = list(zip(*[batch.column(at[c]).to_pylist() for c in pool], strict=True))
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at[text])]
            start = 0
            for i in range(len(batch)):
                if (rows or i > start) and (of[i] != key or rows + i - start >= batch_rows or size + lengths[i] > batch_bytes):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield scored()
                    held, rows, size, start = [], 0, 0, i
                key, size = of[i], size + lengths[i]
            held.append(batch.slice(start))
            rows += len(batch) - start
        if rows:
            yield scored()

    return ranged.mapInArrow(run, df.withColumn("quality", F.lit(0.0)).schema)


def skip_reason(df: DataFrame, group: list[str], min_quality: float, quality_weight: float, rarity_weight: float, order: str, min_margin: float = 0.0) -> DataFrame:
    """Each group with its reason for giving no pair, or null: few_eligible, identical_text,
    rarity_margin."""
    every = df.groupBy(*group).agg(F.sum((F.col("quality") >= min_quality).cast("int")).alias("_fit"))
    best = select_pairs(df, group, order, min_quality, quality_weight, rarity_weight, None)
    joined = every.join(best.select(*group, "chosen", "rejected"), group, "left")
    margin = F.round(F.col("chosen.rarity") - F.col("rejected.rarity"), 9)
    why = F.when(F.col("_fit") < 2, "few_eligible").when(F.col("chosen.text") == F.col("rejected.text"), "identical_text").when(margin < min_margin, "rarity_margin")
    return joined.select(*group, why.alias("reason"))


def pair_records(chosen: DataFrame, prompt: Column, persona: Column, weights: tuple[float, float], min_quality: float, min_margin: float, candidates: Column, cross_persona: bool, source: str = "heuristic") -> DataFrame:
    """prompt, chosen, rejected, metadata: scores rounded to 4, weights, bounds, provenance."""
    score = lambda side, name: F.round(F.col(side)[name], 4).alias(f"{side}_{name}")
    meta = F.struct(
        persona.alias("persona"), *[score(s, x) for s in ("chosen", "rejected") for x in ("quality", "rarity")], F.lit(weights[0]).alias("quality_weight"), F.lit(weights[1]).alias("rarity_weight"),
        F.lit(min_quality).alias("min_quality"), F.lit(min_margin).alias("min_rarity_margin"), candidates.cast("int").alias("candidates_per_prompt"), F.lit(cross_persona).alias("cross_persona"), F.lit(source).alias("quality_source"),
    )
    return chosen.select(prompt.alias("prompt"), F.col("chosen.text").alias("chosen"), F.col("rejected.text").alias("rejected"), meta.alias("metadata"))


def select_pairs(df: DataFrame, group: list[str], order: str, min_quality: float, quality_weight: float, rarity_weight: float, min_margin: float | None = 0.0) -> DataFrame:
    """Chosen and rejected candidate of each group; df has quality, rarity, text.

    Candidates under the floor are out; of at least two left the best and the worst of the
    combined score, the first in `order` winning ties, are the pair. Equal texts and a
    rarity margin under min_margin give no pair (None: they do).
    """
    combined = quality_weight * F.col("quality") + rarity_weight * F.col("rarity")
    fit = df.where(F.col("quality") >= min_quality).withColumn("combined", F.round(combined, 9))
    row = F.struct(F.col("combined"), F.col(order), F.col("text"), F.col("quality"), F.col("rarity"))
    best = F.min(F.struct((-F.col("combined")).alias("c"), F.col(order).alias("o"), row.alias("r")))["r"]
    worst = F.min(F.struct(F.col("combined").alias("c"), F.col(order).alias("o"), row.alias("r")))["r"]
    g = fit.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), best.alias("chosen"), worst.alias("rejected")).where("n >= 2")
    if min_margin is None:
        return g
    margin = F.round(F.col("chosen.rarity") - F.col("rejected.rarity"), 9)
    return g.where((F.col("chosen.text") != F.col("rejected.text")) & (margin >= min_margin))


def select_pairs_any(df: DataFrame, group: list[str], order: str, min_quality: float, quality_weight: float, rarity_weight: float) -> DataFrame:
    """The older rule: chosen is the best candidate over the floor, rejected the worst of
    all others, those under the floor first. Groups of fewer than two candidates, or with
    none over the floor, give no pair; the first in `order` wins ties."""
    scored = df.withColumn("combined", F.round(quality_weight * F.col("quality") + rarity_weight * F.col("rarity"), 9)).withColumn("_fit", F.col("quality") >= min_quality)
    row = F.struct("combined", order, "text", "quality", "rarity")
    best = scored.where("_fit").groupBy(*group).agg(F.min(F.struct((-F.col("combined")).alias("c"), F.col(order).alias("o"), row.alias("r")))["r"].alias("chosen"))
    rest = scored.join(best, group).where(F.col(order) != F.col("chosen")[order])
    worst = F.min(F.struct("_fit", F.col("combined").alias("c"), F.col(order).alias("o"), row.alias("r")))["r"]
    return rest.groupBy(*group, "chosen").agg(worst.alias("rejected"))
