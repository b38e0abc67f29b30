"""Column functions on text: counts, tokens, n-grams, ratios, slugs, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import dims

# Patterns and characters that the filters look for.
URL = r"https?://\S+|www\.\S+"
CODE = r"```[\s\S]*?```|`[^`\n]+`"
MATH_CHARACTERS = r"$\{}^_="
TOKEN = r"[\p{L}\p{N}_]+"
REPEATED = r"(?iU)(\b\w+\b)( \1){3,}"
CLAIM_PREFIX = dims.USER_TEMPLATES["contrarian"]


def n_words(t: Column) -> Column:
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"(?U)\S+"))


def is_empty(t: Column) -> Column:
    return t.isNull() | ~t.rlike(r"(?U)\S")


def has_deleted_marker(t: Column) -> Column:
    return t.contains("[deleted]") | t.contains("[removed]")


def _matched_share(t: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.length)
    return F.aggregate(found, F.lit(0), lambda a, b: a + b) / F.greatest(F.length(t), F.lit(1))


def link_ratio(t: Column) -> Column:
    return _matched_share(t, URL)


def code_ratio(t: Column) -> Column:
    return _matched_share(t, CODE)


def formula_ratio(t: Column) -> Column:
    return (F.length(t) - F.length(F.translate(t, MATH_CHARACTERS, ""))) / F.greatest(F.length(t), F.lit(1))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def ngrams(tok: Column, n: int) -> Column:
    """Joined n-grams; none where the text is shorter than n."""
    if n == 1:
        return tok
    each = F.transform(F.sequence(F.lit(1), F.size(tok) - (n - 1)), lambda i: F.concat_ws(" ", *[F.element_at(tok, i + j) for j in range(n)]))
    return F.when(F.size(tok) >= n, each).otherwise(F.array().cast("array<string>"))


def repetitions(t: Column) -> Column:
    """Words repeated four times or more in a row."""
    return F.regexp_count(t, F.lit(REPEATED))


def slug(t: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(40))


def truncate_claim(t: Column, sentences: int) -> Column:
    """Keep the first sentences of a claim that carries the prefix; other texts stay."""
    body = F.regexp_replace(F.substr(t, F.lit(len(CLAIM_PREFIX) + 1)), r"(?U)^\s+|\s+$", "")
    short = F.array_join(F.slice(F.split(body, r"(?U)(?<=[.!?])\s+"), 1, sentences), " ")
    return F.when(t.startswith(CLAIM_PREFIX), F.concat(F.lit(CLAIM_PREFIX), short)).otherwise(t)
