"""Placeholders for e-mail addresses, telephone numbers and precise addresses by native expressions, with statistics.

Names need a recogniser; any Python callable from text to spans can be plugged in through ``with_names``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity, pattern and placeholder, in the order they are applied.
ENTITIES = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[email]"),
    ("PHONE_NUMBER", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}[.-]\d{3}[.-]\d{4}\b", "[phone]"),
    ("PRECISE_ADDRESS", r"\b\d{1,5} (?:[A-Z][A-Za-z]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Close|Court|Way|Place)\b\.?|\b[A-Z][A-Za-z]+(?:strasse|vej|gade|weg|gasse|straat|laan) \d{1,4}\b|\b(?:Apt|Apartment|Unit|Suite|Flat)\.? \d{1,5}[A-Z]?\b|\b(?:ZIP|Postal Code|Postcode):? \d{4,5}\b|\bDK-\d{4}\b", "[address]"),
)


def high_risk(span: Column) -> Column:
    """A mention of digits alone is none, whatever kind it was taken for."""
    return span.rlike("[^0-9]")


def spans(df: DataFrame, key: str, column: str) -> DataFrame:
    """entity, key, span of every high-risk mention."""

    def of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda s: F.struct(F.lit(name).alias("entity"), s.alias("span")))

    found = F.concat(*[of(name, pattern) for name, pattern, _ in ENTITIES])
    return df.filter(F.col(column).isNotNull()).select(key, F.inline(found)).filter(high_risk(F.col("span"))).select("entity", key, "span")


def anonymised(text: Column) -> Column:
    for _, pattern, placeholder in ENTITIES:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(placeholder))
    return text


def counts(df: DataFrame, column: str) -> DataFrame:
    """entity, n over all texts, from one aggregate; later entities are counted in what earlier ones left."""
    text, aggs = F.col(column), []
    for name, pattern, placeholder in ENTITIES:
        aggs.append(F.coalesce(F.sum(F.regexp_count(text, F.lit(pattern))), F.lit(0)).alias(name))
        text = F.regexp_replace(text, F.lit(pattern), F.lit(placeholder))
    rows = F.array(*[F.struct(F.lit(n).alias("entity"), F.col(n).alias("n")) for n, _, _ in ENTITIES])
    return df.agg(*aggs).select(F.inline(rows))


def anonymised_messages(conversations: DataFrame) -> DataFrame:
    """The text of every message of the array replaced, everything else kept."""
    return conversations.withColumn("messages", F.transform("messages", lambda m: m.withField("text", anonymised(m["text"]))))


def with_names(df: DataFrame, column: str, spans: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            for s, e in sorted(spans(t), reverse=True) if t else []:
                t = t[:s] + "[name]" + t[e:]
            return t

        for s in batches:
            yield s.map(one, na_action="ignore")

    return df.withColumn(column, replace(column))
