"""Chat records: building, validation, messages, adapter chains, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import dims, text as T

MESSAGE = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_record(persona: Column, system: Column, user: Column, answer: Column, source: Column, source_id: Column) -> list[Column]:
    """messages (system, user, assistant) and metadata of a training record."""
    meta = F.create_map(F.lit("persona"), persona, F.lit("source"), source, F.lit("source_id"), source_id)
    return [F.array(message("system", system), message("user", user), message("assistant", answer)).alias("messages"), meta.alias("metadata")]


def user_prompt(persona: Column, slot: Column) -> Column:
    """The persona's template with the slot at its end; an unknown persona is an error."""
    case = F.raise_error(F.concat(F.lit("unknown persona: "), F.coalesce(persona, F.lit("null")))).cast("string")
    for name, template in dims.USER_TEMPLATES.items():
        case = F.when(persona == name, F.concat(F.lit(template), slot)).otherwise(case)
    return case


def messages(prompt: Column, system: Column, counter_argument: bool = False) -> Column:
    """System turn if there is one, then the prompt, wrapped if asked."""
    content = F.concat(F.lit(T.CLAIM_PREFIX), prompt) if counter_argument else prompt
    return F.array_compact(F.array(F.when(F.coalesce(F.length(system), F.lit(0)) > 0, message("system", system)), message("user", content)))


def first_content(msgs: Column, role: str) -> Column:
    found = F.filter(msgs, lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(found, F.lit(1))["content"], F.lit(""))


def normalise_messages(msgs: Column) -> Column:
    """Trimmed messages; an error if a role or content is empty, or a side is missing."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    clean = F.transform(msgs, lambda m: F.struct(strip(m["role"]).alias("role"), strip(m["content"]).alias("content")))
    full = F.forall(clean, lambda m: (F.length(m["role"]) > 0) & (F.length(m["content"]) > 0))
    both = F.exists(clean, lambda m: m["role"] == "user") & F.exists(clean, lambda m: m["role"] == "assistant")
    return F.when(F.coalesce(full & both, F.lit(False)), clean).otherwise(F.raise_error(F.lit("invalid messages")).cast(MESSAGE))


def as_text(value: Column, text: bool = True) -> Column:
    """Trimmed text; null is empty, and so is, of columns that aren't text, what counts as
    nothing (0, false, an empty list)."""
    own = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return own if text else F.when(own.isin("0", "0.0", "false", "[]", "{}"), F.lit("")).otherwise(own)


def of_persona(persona: Column, values: dict[str, str], strict: bool = True) -> Column:
    """The persona's value (system prompt, description); null stays null. Others are an error,
    or null if not strict."""
    case = F.raise_error(F.concat(F.lit("unknown persona: "), persona)).cast("string") if strict else F.lit(None).cast("string")
    for name, value in values.items():
        case = F.when(persona == name, F.lit(value)).otherwise(case)
    return F.when(persona.isNotNull(), case)


def lift_legacy(msgs: Column, persona: Column, prompt: Column, response: Column, prompts: dict[str, str] = dims.SYSTEM_PROMPTS) -> Column:
    """messages if present, else a record built from a flat prompt and response, with the
    persona's system prompt. Flat rows need a known persona, a prompt and a response."""
    text, answer = as_text(prompt), as_text(response)
    fail = lambda why: F.raise_error(F.lit(why)).cast(MESSAGE)
    known = F.coalesce(persona.isin(*prompts), F.lit(False))
    flat = F.array(message("system", of_persona(persona, prompts, strict=False)), message("user", text), message("assistant", answer))
    flat = F.when(~known, fail("a flat record needs a known persona")).when((F.length(text) == 0) | (F.length(answer) == 0), fail("a record needs messages, or a prompt and a response")).otherwise(flat)
    return F.when(msgs.isNotNull(), normalise_messages(msgs)).otherwise(flat)


def metadata_object(value: Column) -> Column:
    """Metadata that is a string of a JSON object, as a map of texts; null for other strings."""
    whole = F.json_array_length(F.concat(F.lit("["), value, F.lit(",1]"))) == 2
    return F.when(whole & value.rlike(r"(?U)^\s*\{.*\}\s*$") & F.try_parse_json(value).isNotNull(), F.from_json(value, "map<string,string>"))


def metadata(raw: Column, persona: Column, source: Column, source_id: Column, id_: Column, given: str | None = None) -> Column:
    """Metadata as text by name, without empty values. persona: the given one, else the column,
    else the metadata's; source: the column, else the metadata's; source_id: the column, else
    the id, else the metadata's. raw: map of texts, null if it was no object; metadata_object()
    gives it for metadata that is a string."""
    kind = "map<string,string>"
    own = F.coalesce(raw, F.create_map().cast(kind))
    clean = F.map_filter(F.transform_values(own, lambda _, v: as_text(v)), lambda _, v: F.length(v) > 0)
    first = lambda *options: F.coalesce(*[F.nullif(o, F.lit("")) for o in options])
    values = {
        "persona": first(F.lit(given).cast("string"), as_text(persona), F.try_element_at(clean, F.lit("persona"))),
        "source": first(as_text(source), F.try_element_at(clean, F.lit("source"))),
        "source_id": first(as_text(source_id), as_text(id_), F.try_element_at(clean, F.lit("source_id"))),
    }
    rest = F.map_filter(clean, lambda k, _: ~k.isin(*values))
    return F.map_concat(rest, F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()))


def overlay(defaults: dict[str, str], arguments: list[str]) -> dict[str, str]:
    """Values by method, replaced by METHOD=VALUE arguments; unknown methods are an error."""
    out = dict(defaults)
    for x in arguments:
        method, found, value = x.partition("=")
        if not found or method not in defaults:
            raise ValueError(f"not METHOD=VALUE of a known method: {x}")
        out[method] = value
    return out


def known_only(df: DataFrame, column: str, known: list[str], nulls: bool = False) -> DataFrame:
    """The rows, each checked: another value (a null too, unless allowed) is an error."""
    c = F.col(column)
    ok = F.coalesce(c.isin(known), F.lit(nulls))
    bad = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(c, F.lit("null")))).cast("string")
    return df.withColumn(column, F.when(ok, c).otherwise(bad))


def union_personas(sets: dict[str, DataFrame], seed: int | None = None, key: str | None = None) -> DataFrame:
    """Rows of all personas, in a seeded order if a seed and a key are given."""
    out = None
    for name, own in sets.items():
        own = own.withColumn("persona", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out if seed is None else out.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def as_training_text(msgs: Column) -> Column:
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n")


def adapter_chain(stage: Column, persona: Column, single: str = "all", sft_stage: str = "sft") -> Column:
    """Adapters to stack for a stage, in order; unknown stages and lacking personas fail."""
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(stage, F.lit("null")))).cast("array<string>")
    sft = (stage == "sft") | stage.startswith("sft_")
    divpo = (stage == "divpo") | stage.startswith("divpo_")
    own = F.concat(stage, F.lit("/"), persona)
    return (
        F.when(stage == "base", F.array().cast("array<string>"))
        .when(stage == "single", F.array(F.lit(f"single/{single}")))
        .when((sft | divpo) & persona.isNull(), fail("a persona is required by stage "))
        .when(sft, F.array(own))
        .when(divpo, F.array(F.concat(F.lit(f"{sft_stage}/"), persona), own))
        .otherwise(fail("unknown stage "))
    )


def root_replies(turns: DataFrame) -> DataFrame:
    """Each conversation's first user turn with the assistant turns that follow it."""
    root = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("r"))
    root = root.select("conv_id", F.col("r.turn").alias("root_turn"), F.col("r.text").alias("claim"))
    replies = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))
    return root.join(replies, "conv_id").where(F.col("turn") > F.col("root_turn"))


def question_answers(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    q = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def peers(df: DataFrame, group: list[str], key: str, value: str, limit: int = 3) -> DataFrame:
    """The first `limit` other members of each row's group, in the order of the key.

    The first limit + 1 rows of each group are enough for all of its rows.
    """
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(key))).where(F.col("_rn") <= limit + 1)
    few = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias("_few"))
    other = F.slice(F.filter("_few", lambda x: x["k"] != F.col(key)), 1, limit)
    return df.join(few, group).withColumn("peers", F.transform(other, lambda x: x["v"])).drop("_few")
