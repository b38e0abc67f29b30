"""Briefs, idea cards and their training rows; sources and task variants as dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.records import message

#: Each persona's move, the task variants of a seed record, the cards' fields, the
#: prefixes of older prompts, and where each persona's training data come from.
OPERATIONS = {"contrarian": "challenge_thesis", "cross_domain_analogist": "transfer_analogy", "systems_thinker": "map_system", "minimalist": "distill_core"}
VARIANTS = ["thesis", "angle", "outline", "evidence", "audience", "revision", "comparison", "next_move"]
CARD_FIELDS = ["persona", "operation", "diagnosis", "idea", "rationale", "next_step"]
THREAD_PREFIX = "Challenge this assumption for pre-writing ideation: "
QUESTION_PREFIX = "Analyze this question through causes, constraints, and feedback loops: "


def brief_text(topic: Column, goal: Column, audience: Column, constraints: Column) -> Column:
    """The prompt block of a brief. Topic and goal must not be empty; no audience means general
    readers; without constraints their line is left out."""
    need = lambda c, name: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c).otherwise(F.raise_error(F.lit(f"a brief needs a {name}")).cast("string"))
    who = F.when(F.length(F.coalesce(audience, F.lit(""))) > 0, audience).otherwise(F.lit("general readers"))
    limits = F.when(F.size(F.coalesce(constraints, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Constraints: "), F.array_join(constraints, "; ")))
    return F.concat_ws("\n", F.concat(F.lit("Topic: "), need(topic, "topic")), F.concat(F.lit("Writer goal: "), need(goal, "goal")), F.concat(F.lit("Audience: "), who), limits)


def operation(persona: Column) -> Column:
    """The persona's move; that of all personas together where there is none."""
    case = F.lit("synthesize_angles")
    for name, move in OPERATIONS.items():
        case = F.when(persona == name, move).otherwise(case)
    return case


def card(persona: Column, topic: Column, source: Column) -> Column:
    """An idea card by rule: the persona's move applied to the topic, with a source's sentence."""
    move = operation(persona)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.struct(
        persona.alias("persona"), move.alias("operation"), say("The brief on ", topic, " leaves its main claim open.").alias("diagnosis"),
        say(F.translate(move, "_", " "), ": ", source).alias("idea"), say("It follows from the move ", move, ".").alias("rationale"), say("Write one paragraph on ", topic, ".").alias("next_step"),
    )


def seed_variants(seeds: DataFrame) -> DataFrame:
    """Each seed record once for each task variant."""
    return seeds.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))


def external_rows(sources: DataFrame, id_col: str, topic: str, text: str) -> DataFrame:
    """Each external record as a (brief, card) row for every persona."""
    rows = sources.withColumn("persona", F.explode(F.array(*map(F.lit, OPERATIONS))))
    made = card(F.col("persona"), F.col(topic), F.col(text))
    return rows.select(F.col(id_col), "persona", brief_text(F.col(topic), F.lit("Find a sharper thesis"), F.lit(None), F.lit(None).cast("array<string>")).alias("brief"), made.alias("card"))


def thread_prompt(title: Column) -> Column:
    return F.concat(F.lit(THREAD_PREFIX), title)


def question_prompt(question: Column) -> Column:
    return F.concat(F.lit(QUESTION_PREFIX), question)


def session(turns: DataFrame, key: str, turn: str, user: str, answer: str, prior: str) -> DataFrame:
    """Each turn's messages: those of all turns before it, then its own; prior art stands before
    the first turn's text alone. A session's turns are in one task's memory."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(turn)) == 1
    asked = F.when(first & (F.length(F.coalesce(F.col(prior), F.lit(""))) > 0), F.concat(F.col(prior), F.lit("\n\n"), F.col(user))).otherwise(F.col(user))
    rows = turns.withColumn("_asked", asked)
    before = F.flatten(F.collect_list(F.array(message("user", F.col("_asked")), message("assistant", F.col(answer)))).over(Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)))
    return rows.select(key, turn, F.concat(before, F.array(message("user", F.col("_asked")))).alias("messages"))


def source_registry(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """persona, source, kind: where each persona's data come from, as data."""
    return spark.createDataFrame(entries, "persona string, source string, kind string")
