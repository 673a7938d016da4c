"""All measures of a turn in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUARDS = ("user_cross_check_5", "assistant_cross_check_5")
KEYS = ("conv_id", "turn", *GUARDS)


def attach(base: DataFrame, measure: DataFrame, suffix: str) -> DataFrame:
    """Left join on conversation, turn and, where both sides have them, the text guards; null guards match each other.

    Columns of the measure that the base has already get the suffix. conv_id and turn are equi keys, so the join is hashed on
    them and the null-safe guards only filter.
    """
    keys = [k for k in KEYS if k in measure.columns and k in base.columns]
    other = measure.select(*[F.col(c).alias(f"_r_{c}") for c in measure.columns])
    same = [base[k].eqNullSafe(other[f"_r_{k}"]) if k in GUARDS else base[k] == other[f"_r_{k}"] for k in keys]
    joined = base.join(other, reduce(lambda a, b: a & b, same), "left")
    rest = [c for c in measure.columns if c not in keys]
    return joined.select(*[base[c] for c in base.columns], *[F.col(f"_r_{c}").alias(c + suffix if c in base.columns else c) for c in rest])


def without_suffixed(df: DataFrame, suffixes: tuple[str, ...], keep: tuple[str, ...] = ("user_sentiment", "assistant_sentiment")) -> DataFrame:
    """The columns that end in one of the suffixes dropped, but for those named."""
    return df.drop(*[c for c in df.columns if c.endswith(suffixes) and c not in keep])


def merged(base: DataFrame, measures: dict[str, DataFrame], topics: DataFrame | None = None) -> DataFrame:
    out = base
    for suffix, m in measures.items():
        out = attach(out, m, f"_{suffix}")
    if topics is not None:
        out = attach(out, topics, "_topics")
    return without_suffixed(out, tuple(f"_{s}" for s in (*measures, "topics")))
