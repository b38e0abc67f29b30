"""Metric tables: automated and judged metrics by method and prompt, and their breakdowns.

Generations: method, prompt, persona (may be null), output_id, output, u (unit vector).
Observations are long: method, prompt, metric, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import vectors as V
from loomline.functions.joins import null_join
from loomline.operators import diversity, judge, neighbours
from loomline.sources.scratch import written

#: The members of each rubric's answer that make its score.
RUBRIC_KEYS = {"quality": ("relevance", "coherence", "substance"), "novelty": ("novelty",), "utility": ("prewriting_utility",), "persona_fidelity": ("persona_fidelity",)}


def judge_scalar(block: Column, rubric: str) -> Column:
    """One score from a rubric's answer, a JSON object as text: the mean of its numbers."""
    return judge.mean_of(*[judge.number(block, k) for k in RUBRIC_KEYS[rubric]])


def long(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """by, metric, value: a row for each metric that isn't null."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]))
    return df.select(*by, each.alias("_m")).select(*by, "_m.*").where("value is not null")


def automated(gen: DataFrame, by: list[str], dim: int) -> DataFrame:
    """One row a group: n, self_bleu, distinct_1, distinct_2, sbert_cosine, sbert_distance."""
    g = V.group_sums(gen, by, dim).select(*by, "n", V.mean_pairwise(F.col("n"), F.col("S"), F.col("q")).alias("sbert_cosine"))
    grams = written(diversity.gram_stats(gen, by, "output", "output_id", (1, 2, 3, 4)), "grams")
    out = g.join(diversity.self_bleu_of(grams, by), by).join(diversity.distinct_of(grams, by), by)
    return out.withColumn("sbert_distance", 1 - F.col("sbert_cosine"))


def per_prompt_automated(gen: DataFrame, dim: int, novelty: DataFrame | None = None) -> DataFrame:
    """Observations of prompts with two outputs at least. novelty: method, prompt,
    corpus_novelty; where it has no row the metric is absent."""
    by = ["method", "prompt"]
    out = automated(gen, by, dim).where("n >= 2")
    out = out.withColumn("corpus_novelty", F.lit(None).cast("double")) if novelty is None else out.join(novelty, by, "left")
    return long(out, by, {m: F.col(m) for m in ("self_bleu", "distinct_1", "distinct_2", "sbert_cosine", "corpus_novelty")})


def per_prompt_judged(scored: DataFrame) -> DataFrame:
    """Observations of rubrics, means over a prompt's outputs. scored: method, prompt, and a
    column a rubric (JSON text, null where it wasn't asked). All null: the metric is absent."""
    by = ["method", "prompt"]
    rubrics = [r for r in RUBRIC_KEYS if r in scored.columns]
    each = long(scored, by, {r: judge_scalar(F.col(r), r) for r in rubrics})
    return each.groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def last_judgement(judged: DataFrame, order: str) -> DataFrame:
    """One row an output_id, the last in `order`; rows without an id are left out."""
    rows = judged.where("output_id is not null and cast(output_id as string) <> ''")
    return rows.groupBy("output_id").agg(F.max_by(F.struct(*[c for c in judged.columns if c != "output_id"]), order).alias("_r")).select("output_id", "_r.*")


def persona_order(persona: Column) -> Column:
    """Place in the canonical order; others come after all of these."""
    at = F.array_position(F.array(*map(F.lit, dims.PERSONAS)), persona)
    return F.when(at > 0, at).otherwise(F.lit(len(dims.PERSONAS) + 1))


def report_order() -> list[Column]:
    """Rows by run, method, canonical persona, persona."""
    return [F.col("run"), F.col("method"), persona_order(F.col("persona")), F.col("persona")]


def breakdown(gen: DataFrame, judged: DataFrame, order: str, dim: int, run: str) -> DataFrame:
    """A row for each method and persona: n_outputs, diversity, and of each rubric the mean and
    the number of scores. Outputs without a judgement count for diversity alone.

    judged: output_id, `order`, and a JSON text column a rubric; of repeated ids the last counts.
    """
    by = ["method", "persona"]
    own = gen.where(F.col("persona").isNotNull())
    scores = last_judgement(judged, order).select("output_id", *[judge_scalar(F.col(r), r).alias(f"_{r}") for r in RUBRIC_KEYS])
    means = own.select(*by, "output_id").join(scores, "output_id", "left").groupBy(*by)
    means = means.agg(*[F.avg(f"_{r}").alias(r) for r in RUBRIC_KEYS], *[F.count(f"_{r}").alias(f"{r}_n") for r in RUBRIC_KEYS])
    out = automated(own, by, dim).join(means, by)
    names = ["self_bleu", "distinct_1", "distinct_2", "sbert_cosine", "sbert_distance", *RUBRIC_KEYS, *[f"{r}_n" for r in RUBRIC_KEYS]]
    return out.select(F.lit(run).alias("run"), *by, F.col("n").alias("n_outputs"), *names)


def best_reference(scores: DataFrame, references: int) -> DataFrame:
    """Each output's best score over its k references. scores: output_id, ref_rank (from 0),
    score. A list shorter than `references` is padded with its first one, which can't change
    the maximum; n_references tells how many there were."""
    rows = scores.where(F.col("ref_rank") < references)
    return rows.groupBy("output_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n_references"))


def flat_evaluation(gen: DataFrame, dim: int, base: str) -> DataFrame:
    """A method's diversity over all its outputs, beside the base method's, one row each."""
    out = automated(gen, ["method"], dim)
    ref = out.where(F.col("method") == base).select(*[F.col(c).alias(f"base_{c}") for c in ("self_bleu", "distinct_1", "distinct_2", "sbert_cosine")])
    return out.join(F.broadcast(ref), how="left")  # one row


def evaluate_outputs(gen: DataFrame, dim: int, references: DataFrame, prompts: DataFrame, by: list[str]) -> DataFrame:
    """The seven metrics of a set of outputs, one row a group: distinct_1, distinct_2, self_bleu,
    sbert_pairwise_mean, corpus_novelty_mean and corpus_novelty_min (one less the similarity with
    the nearest reference), quality_proxy (mean cosine of outputs with their prompt).

    gen: `by`, output_id (unique), prompt, output, u. references: ref_id, ru. prompts: prompt, pu.
    Without references there is no novelty; outputs without a prompt's vector don't count in the proxy.
    """
    near = neighbours.search(gen.select(F.col("output_id").alias("id"), "u"), references, 1)[0]
    novelty = gen.select(*by, "output_id").join(near.select(F.col("id").alias("output_id"), (1 - F.col("similarity")).alias("nov")), "output_id").groupBy(*by)
    novelty = novelty.agg(F.avg("nov").alias("corpus_novelty_mean"), F.min("nov").alias("corpus_novelty_min"))
    proxy = gen.join(prompts, "prompt").groupBy(*by).agg(F.avg(V.dot(F.col("u"), F.col("pu"))).alias("quality_proxy"))
    out = automated(gen, by, dim).withColumnRenamed("sbert_cosine", "sbert_pairwise_mean").drop("sbert_distance")
    return null_join(null_join(out, novelty, by, "left"), proxy, by, "left")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that a seed fixes; ties in the hash by key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def top_by_persona(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of the largest value of each persona; ties by key."""
    rn = F.row_number().over(Window.partitionBy("persona").orderBy(F.col(value).desc(), key))
    return df.withColumn("rank", rn).where(F.col("rank") <= n)
