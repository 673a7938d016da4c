"""Language of whole conversations for the reference pipeline: a stop-word profile as native expressions, any detector as a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.operators.pairs import role_name

#: Common words that tell a language (fixed values).
STOP_WORDS = {
    "en": "the and of to is that for with you it this are not what how can",
    "de": "der die das und ist nicht mit ein eine ich wie was auf für den",
    "fr": "le la les des et est que pour avec dans pas vous une sur qui",
    "es": "el la los las y es que para con una no por se del cómo",
}
#: Characters below which nothing is said and below which little is sure; least confidence.
LEAST_CHARS, SURE_CHARS, SURE = 20, 100, 0.8


def english(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("conversation_language") == "en")


def spoken_text(messages: Column) -> Column:
    """User and assistant texts joined by a space."""
    said = F.filter(messages, lambda m: role_name(m["role"]).isin("user", "assistant") & m["text"].isNotNull())
    return F.trim(F.coalesce(F.array_join(F.transform(said, lambda m: m["text"]), " "), F.lit("")))


def detected(shares: DataFrame, detector: Callable[[str], tuple[str, float]] | None = None) -> DataFrame:
    """share_id, language, n_chars, confidence, low_confidence; ``unknown`` for texts too short or without a telling word."""
    text = shares.select("share_id", spoken_text(F.col("messages")).alias("t")).withColumn("n_chars", F.length("t"))
    if detector is None:
        words = F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "")
        listed = lambda ws: F.size(F.filter("w", lambda x: x.isin(*ws.split())))
        counted = text.withColumn("w", words).select("share_id", "n_chars", *[listed(ws).alias(la) for la, ws in STOP_WORDS.items()])
        best, total = F.greatest(*STOP_WORDS), sum((F.col(la) for la in STOP_WORDS), F.lit(0))
        told = F.when(total > 0, F.coalesce(*[F.when(F.col(la) == best, la) for la in STOP_WORDS]))
        scored = counted.select("share_id", "n_chars", told.alias("language"), F.when(total > 0, best / total).alias("confidence"))
    else:

        @F.pandas_udf("language string, confidence double")
        def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                yield pd.DataFrame([detector(t) for t in s], columns=["language", "confidence"])

        scored = text.withColumn("g", detect("t")).select("share_id", "n_chars", "g.language", "g.confidence")
    unknown = (F.col("n_chars") < LEAST_CHARS) | F.col("language").isNull()
    return scored.select(
        "share_id", F.when(unknown, "unknown").otherwise(F.col("language")).alias("language"), "n_chars", F.when(unknown, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        (unknown | (F.col("n_chars") < SURE_CHARS) | (F.col("confidence") < SURE)).alias("low_confidence"),
    )
