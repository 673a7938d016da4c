"""Alignment measures of turn pairs, all as native expressions; model-backed ones take a scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.functions.lexicons import FUNCTION_WORDS, NEGATIVE, POSITIVE
from colloqua.functions.text import listed, proportions, tokens, words

EPSILON = 1e-8


def lsm(left: Column, right: Column) -> Column:
    """Mean over the categories of 1 - |p - q| / (p + q + epsilon) of two proportion structs."""
    parts = [1 - F.abs(left[c] - right[c]) / (left[c] + right[c] + EPSILON) for c in FUNCTION_WORDS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union)


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def polarity(toks: Column) -> Column:
    """Lexicon polarity of tokens in [-1, 1], 0 without a listed word; the default in place of a neural classifier."""
    p, n = listed(toks, POSITIVE), listed(toks, NEGATIVE)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))


def polarity_similarity(user: Column, assistant: Column) -> Column:
    return 1 - F.abs(user - assistant) / 2


def token_estimate(text: Column) -> Column:
    return F.size(words(text))


def measured(pairs: DataFrame) -> DataFrame:
    """The pairs with LSM, lexical Jaccard, both polarities, their similarity and the token total.

    Proportions stand in columns of their own, so each text is tokenised once and not once a category.
    """
    u, a = F.col("user_text"), F.col("assistant_text")
    low = lambda t: words(F.lower(t))
    toks = pairs.withColumns({"_ut": tokens(u), "_at": tokens(a)})
    polar = toks.withColumns({"_up": proportions(F.col("_ut")), "_ap": proportions(F.col("_at")), "user_sentiment": polarity(F.col("_ut")), "assistant_sentiment": polarity(F.col("_at"))})
    return (
        polar.withColumn("lsm_score", lsm(F.col("_up"), F.col("_ap")))
        .drop("_ut", "_at", "_up", "_ap")
        .withColumn("lexical_jaccard", jaccard(low(u), low(a)))
        .withColumn("sentiment_similarity", polarity_similarity(F.col("user_sentiment"), F.col("assistant_sentiment")))
        .withColumn("n_tokens_total", token_estimate(u) + token_estimate(a))
    )


#: Closed classes of the default tagger, in the order they are tried; other words are tagged by ending (fixed values).
CLOSED = (("DET", FUNCTION_WORDS["articles"] + " this that these those every each"), ("ADP", FUNCTION_WORDS["prepositions"]), ("PRON", FUNCTION_WORDS["pronouns"]), ("AUX", FUNCTION_WORDS["aux_verbs"]), ("CCONJ", "and or but nor yet"), ("SCONJ", "although because if since though unless whereas while"), ("PART", "not to n't"), ("ADV", FUNCTION_WORDS["adverbs_common"]))
ENDINGS = (("ADV", "ly"), ("VERB", "ing|ed|ise|ize|ify"), ("ADJ", "ous|ful|ive|able|ible|al|ic"))
SIGNS = ".,;:!?\"'()[]"


def rule_tags(text: Column) -> Column:
    """Coarse part-of-speech tags of the different words by closed classes and endings; signs around a word are dropped."""

    def tag(w: Column) -> Column:
        core, low = w["core"], w["low"]
        out = F.when(core == "", "PUNCT").when(core.rlike(r"^[0-9]"), "NUM")
        for name, listed_ in CLOSED:
            out = out.when(low.isin(*listed_.split()), name)
        for name, ends in ENDINGS:
            out = out.when(low.rlike(f"({ends})$"), name)
        return out.when(core.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")

    cores = F.array_distinct(F.transform(words(text), lambda w: F.btrim(w, F.lit(SIGNS))))
    return F.transform(F.transform(cores, lambda c: F.struct(c.alias("core"), F.lower(c).alias("low"))), tag)


def tagged(df: DataFrame, column: str, to: str, tagger: Callable[[str | None], list[str]]) -> DataFrame:
    """``df`` with the tags of a text column by any Python tagger, loaded once per worker."""

    @F.pandas_udf("array<string>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(tagger)

    return df.withColumn(to, tags(column))


def scored(df: DataFrame, column: str, to: str, scorer: Callable[[list[str | None]], list[float]], batch: int = 64) -> DataFrame:
    """``df`` with the polarity of a text column by any Python scorer of batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = list(s)
            yield pd.Series([x for lo in range(0, len(texts), batch) for x in scorer(texts[lo : lo + batch])], dtype="float64")

    return df.withColumn(to, score(column))


def pos_jaccard(pairs: DataFrame) -> DataFrame:
    both = pairs.withColumns({"_u": rule_tags(F.col("user_text")), "_a": rule_tags(F.col("assistant_text"))})
    return both.withColumn("pos_jaccard", jaccard(F.col("_u"), F.col("_a"))).drop("_u", "_a")


def unique_messages(pairs: DataFrame) -> DataFrame:
    """message_id, text of both sides of the pairs, once per id."""
    side = lambda s: pairs.select(F.col(f"{s}_message_id").alias("message_id"), F.col(f"{s}_text").alias("text"))
    return side("user").unionByName(side("assistant")).filter("message_id is not null").groupBy("message_id").agg(F.max("text").alias("text"))


def hashed_embeddings(messages: DataFrame, slots: int = 64) -> DataFrame:
    """message_id, embedding: unit vector of hashed word counts (first 32 bits of md5 modulo ``slots``), the default in place of a
    neural embedder; a text without words has none."""
    said = messages.select("message_id", F.explode(words(F.lower("text"))).alias("w"))
    slot = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % slots).cast("int")
    counts = said.groupBy("message_id", slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy("message_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))  # at most ``slots`` entries
    return rows.select("message_id", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("embedding"))


def embedded(messages: DataFrame, embedder: Callable[[list[str]], list] | None = None, batch: int = 256) -> DataFrame:
    """message_id, embedding of unique messages by a Python embedder of batches, loaded once per worker, or by hashing."""
    if embedder is None:
        return hashed_embeddings(messages)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            yield pd.Series([[float(v) for v in x] for lo in range(0, len(texts), batch) for x in embedder(texts[lo : lo + batch])])

    return messages.select("message_id", embed("text").alias("embedding"))


def looked_up(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The pairs with ``user_{column}`` and ``assistant_{column}`` from a table by message_id, null where it has none."""
    out = pairs
    for s in ("user", "assistant"):
        out = out.join(values.select(F.col("message_id").alias(f"{s}_message_id"), F.col(column).alias(f"{s}_{column}")), f"{s}_message_id", "left")
    return out


def with_cross_checks(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """Cross-checks filled from the messages' texts where they are null; an unknown message gives an empty one."""
    texts = looked_up(pairs, messages, "text")
    fill = {f"{s}_cross_check_5": F.coalesce(f"{s}_cross_check_5", F.substring(f"{s}_text", 1, 5), F.lit("")) for s in ("user", "assistant")}
    return texts.withColumns(fill).drop("user_text", "assistant_text")
