"""String functions as native column expressions: tokens, blank tests and the markdown cleaning chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloqua.functions.lexicons import CODE_KEYWORDS, CODE_SIGNS, FORMAL_KEYWORDS, FUNCTION_WORDS

#: Python's white space, also in Java patterns.
SPACE = r"[\s\x1c-\x1f]"


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """White-space separated words; punctuation stays."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """ASCII letter runs with apostrophes, matched and then lowered."""
    return F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z']+)"), F.lit(1)), F.lower)


def cross_check(text: Column) -> Column:
    return F.substring(text, 1, 5)


def listed(toks: Column, words_: str) -> Column:
    """How many of the tokens are in a list; ``isin`` of a long list is a hash lookup, unlike array_contains."""
    return F.size(F.filter(toks, lambda t: t.isin(*words_.split())))


def proportions(toks: Column) -> Column:
    """struct of the share of each function-word category; all 0 without tokens."""
    n = F.size(toks)

    def share(category: str) -> Column:
        return F.when(n > 0, listed(toks, FUNCTION_WORDS[category]) / n).otherwise(F.lit(0.0)).alias(category)

    return F.struct(*[share(c) for c in FUNCTION_WORDS])


#: The cleaning steps in their order: pattern and replacement (fixed values).
STEPS = (
    ("inline_code", r"`([^`]+)`", "$1"),
    ("headers", r"(?mdU)^#{1,6}\s+", ""),
    ("bold", r"\*\*([^*]+)\*\*", "$1"),
    ("bold_underscore", r"__(?![a-zA-Z0-9_]+__)([^_]+)__", "$1"),
    ("italic", r"\*([^*]+)\*", "$1"),
    ("italic_underscore", r"(?U)(?<![a-zA-Z0-9])_(?![a-zA-Z0-9_]+_)([^_\s]+)_(?![a-zA-Z0-9])", "$1"),
    ("strike", r"~~([^~]+)~~", "$1"),
    ("links", r"\[([^\]]+)\]\([^)]+\)", "$1"),
    ("urls", r"(?U)https?://\S+", ""),
    ("bullets", r"(?mdU)^[\s]*[-*+]\s+", ""),
    ("numbers", r"(?mdU)^[\s]*\d+\.\s+", ""),
    ("quotes", r"(?mdU)^>\s+", ""),
    ("rules", r"(?mdU)^[-*_]{3,}\s*$", ""),
    ("tables", r"\|[^\n]+\|", ""),
    ("html", r"<[^>]+>", ""),
    ("boxes", r"[─-◿]+", ""),
    ("repeats", r"([=\-_~])\1{3,}", ""),
    ("format_characters", r"\p{Cf}", ""),
    ("newlines", r"\n{3,}", "\n\n"),
    ("spaces", r"[ ]{2,}", " "),
    ("line_trim", r"(?mdU)^\s+|\s+$", ""),
)


def step(text: Column, name: str) -> Column:
    pattern, to = next((p, r) for n, p, r in STEPS if n == name)
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def block_kind(block: Column) -> Column:
    """Placeholder of a fenced block: empty or plain data, formal specification, or code."""
    body = F.regexp_replace(F.regexp_replace(block, r"\A```[a-zA-Z0-9]*\n?", ""), r"\n?```\z", "")
    low = F.lower(body)
    holds = lambda keys: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])
    signs = reduce(lambda a, b: a + b, [F.contains(body, F.lit(s)).cast("int") for s in CODE_SIGNS])
    return F.when(strip(body) == "", "[DATA_DUMP_BLOCK]").when(holds(FORMAL_KEYWORDS), "[FORMAL_SPEC_BLOCK]").when(holds(CODE_KEYWORDS) | (signs >= 2), "[CODE_BLOCK_EXECUTABLE]").otherwise("[DATA_DUMP_BLOCK]")


def replace_blocks(text: Column) -> Column:
    """Fenced blocks replaced by their typed placeholder with a space on either side."""
    fence = F.lit(r"(```[\s\S]*?```)")
    kinds = F.transform(F.regexp_extract_all(text, fence, F.lit(1)), lambda b: F.concat(F.lit(" "), block_kind(b), F.lit(" ")))
    between = F.split(text, r"```[\s\S]*?```", -1)
    return F.when(F.contains(text, F.lit("```")), F.array_join(F.flatten(F.zip_with(between, kinds, lambda t, k: F.array(t, F.coalesce(k, F.lit(""))))), "")).otherwise(text)


def clean_markdown(text: Column) -> Column:
    """The whole chain; null and empty texts stay as they are."""
    out = replace_blocks(text)
    for name, _, _ in STEPS:
        out = step(out, name)
    return F.when(F.length(text) > 0, strip(out)).otherwise(text)


def without_notice(text: Column) -> Column:
    """The notice about lost custom instructions removed; stripped only where it stood."""
    notice = r"(?iU)original\s+custom\s+instructions\s+no\s+longer\s+available"
    return F.when(text.rlike(notice), strip(F.regexp_replace(text, notice, ""))).otherwise(text)
