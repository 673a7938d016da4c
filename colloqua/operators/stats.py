"""Filters, standardisation, correlations, rankings and intervals over the merged table."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def model_family(slug: Column) -> Column:
    return F.when(slug.rlike("^gpt-4"), "gpt-4").when(slug.rlike("^gpt-5"), "gpt-5").when(slug.rlike("^o"), "o-series").otherwise("other")


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "t", "1", "yes"), F.lit(False))


def tools_flag(value: Column) -> Column:
    return F.coalesce(~F.trim(value).isin("", "[]", "na", "null"), F.lit(False))


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def fmt_n(value: Column) -> Column:
    """A number with thousands separated and at most two decimals."""
    return F.call_function("format_number", value.cast("double"), F.lit("#,##0.##"))


def fmt_pct(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", F.round(100.0 * share, 1)))


def topic_labels(rows: DataFrame, topic: str, keywords: str) -> DataFrame:
    """topic, label: the first two keywords and the number of conversations; keyed by topic, so equal labels do not merge topics."""
    first = rows.groupBy(topic).agg(F.min(keywords).alias("k"), F.countDistinct("conv_id").alias("n"))
    return first.select(topic, F.concat(F.array_join(F.slice(F.split("k", " / "), 1, 2), ", "), F.lit(" (n="), F.col("n"), F.lit(")")).alias("label"))


def marginal_means(estimates: DataFrame, *by: str) -> DataFrame:
    """Mean estimate and root mean square error."""
    return estimates.groupBy(*by).agg(F.avg("estimate").alias("estimate"), F.sqrt(F.avg(F.col("std_error") * F.col("std_error"))).alias("std_error"))


def grid(rows: DataFrame, by: list[str], turn: str, turns: int) -> DataFrame:
    """Every combination of the values of ``by`` with turns 1 to ``turns``; values are few, so each factor is broadcast by its size."""
    out = rows.select(by[0]).distinct()
    for c in by[1:]:
        out = out.crossJoin(rows.select(c).distinct())
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(turns).cast("bigint"))))


def within_length(turns: DataFrame, least: int = 2, quantile: float = 0.95) -> DataFrame:
    """Turns of conversations with at least ``least`` turns and at most the quantile of lengths (interpolated)."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    top = lengths.agg(F.percentile("n_turns", F.lit(quantile)).alias("p")).select("p")
    valid = lengths.crossJoin(F.broadcast(top)).filter((F.col("n_turns") >= least) & (F.col("n_turns") <= F.col("p")))  # one row
    return turns.join(valid.select("conv_id"), "conv_id", "left_semi")


def supported(turns: DataFrame, least: int = 200) -> DataFrame:
    """Turns whose absolute number is reached by at least ``least`` conversations."""
    t = turns.withColumn("abs_turn", F.abs("turn"))
    support = t.groupBy("abs_turn").agg(F.countDistinct("conv_id").alias("n")).filter(F.col("n") >= least)
    return t.join(support.select("abs_turn"), "abs_turn", "left_semi")


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def standardised(long: DataFrame) -> DataFrame:
    """``z`` by metric. Mean and deviation come from a small aggregate, so no metric's rows meet in one task."""
    stats = long.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return long.join(F.broadcast(stats), "metric").withColumn("z", (F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")  # a row a metric


def pearson(x: Column, y: Column) -> Column:
    """Pairwise complete correlation, null without variance."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """x, y, n, r of every pair of metrics, from one aggregate."""
    pairs = list(combinations(metrics, 2))
    aggs = [c for i, (x, y) in enumerate(pairs) for c in (pearson(F.col(x), F.col(y)).alias(f"r{i}"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}"))]
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(rows))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    from math import exp, lgamma, log

    if not np.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return min(1.0, front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b)


def correlation_p_values(corr: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or m <= 2 else student_p(np.inf if abs(a) >= 1 else a * np.sqrt((m - 2) / (1 - a * a)), m - 2) for a, m in zip(r, n)])

    return corr.withColumn("p_value", p("r", "n"))


def rolling_correlations(means: DataFrame, metrics: list[str], width: int = 5, least: int = 3) -> DataFrame:
    """x, y, abs_turn, r over the last ``width`` turn numbers; ``means`` has one row per turn number, so the window is small."""
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("vx"), F.col(y).alias("vy")) for x, y in combinations(metrics, 2)]
    rows = means.select("abs_turn", F.inline(F.array(*pairs)))
    w = Window.partitionBy("x", "y").orderBy("abs_turn").rowsBetween(1 - width, 0)
    a, b = F.when(F.col("vy").isNotNull(), F.col("vx")), F.when(F.col("vx").isNotNull(), F.col("vy"))
    r = F.covar_pop(a, b).over(w) / F.nullif(F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w), F.lit(0.0))
    return rows.select("x", "y", "abs_turn", F.when(F.count(a).over(w) >= least, r).alias("r"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    r = F.col("r")
    ok = r.isNotNull()
    return rolling.groupBy("x", "y").agg(
        F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"),
        F.avg(F.when(ok, (F.abs(r) > 0.3).cast("double"))).alias("share_30"), F.avg(F.when(ok, (F.abs(r) > 0.5).cast("double"))).alias("share_50"),
        F.when(F.count("r") > 2, F.regr_slope(r, F.col("abs_turn").cast("double"))).alias("slope"),
    )


def average_rank(value: Column, *by: str) -> Column:
    """Rank by falling value where ties get the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value.desc())
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def intervals(draws: DataFrame, *by: str, level: float = 0.89) -> DataFrame:
    """Median, bounds of the central interval and sign probabilities of posterior draws."""
    lo = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(lo), F.lit(0.5), F.lit(1 - lo)))
    return draws.groupBy(*by).agg(q.alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("p_pos"), F.avg((F.col("value") < 0).cast("double")).alias("p_neg")).select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "p_pos", "p_neg")


def topic_table(draws: DataFrame, sizes: DataFrame) -> DataFrame:
    """Intervals, rank probabilities and sizes of each topic, its median over all metrics and the spread of its medians."""
    real = draws.filter(~F.startswith("topic", F.lit(".")))
    numbered = real.withColumn("draw", F.concat_ws("_", "chain", "draw"))
    medians = intervals(real, "metric", "topic")
    across = medians.groupBy("topic").agg(F.median("median").alias("overall_median"), F.stddev_samp("median").alias("dispersion"))
    return medians.join(rank_probabilities(numbered), ["metric", "topic"], "left").join(sizes, "topic", "left").join(across, "topic", "left")


def rank_probabilities(draws: DataFrame, best: int = 3) -> DataFrame:
    ranked = draws.withColumn("rank", average_rank(F.col("value"), "metric", "draw"))
    return ranked.groupBy("metric", "topic").agg(F.avg((F.col("rank") == 1).cast("double")).alias("p_first"), F.avg((F.col("rank") <= best).cast("double")).alias("p_top"))


def top(df: DataFrame, by: list[str], order: Column, n: int, ties: bool) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_p", (F.rank() if ties else F.row_number()).over(w)).filter(F.col("_p") <= n).drop("_p")


def contrast(marginal: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Difference of two directions and its standard error; one pivot instead of a self-join."""
    p = marginal.groupBy(*by).pivot("direction", [first, second]).agg(F.first("estimate").alias("e"), F.first("std_error").alias("s"))
    e1, e2, s1, s2 = (F.col(f"`{d}_{c}`") for c in "es" for d in (first, second))
    return p.filter(e1.isNotNull() & e2.isNotNull()).select(*by, (e1 - e2).alias("difference"), F.sqrt(s1 * s1 + s2 * s2).alias("std_error"))


def weighted_means(rows: DataFrame, *by: str) -> DataFrame:
    """Weighted mean of ``estimate``, its standard error and 95 % bounds."""
    w, e, s = F.col("weight"), F.col("estimate"), F.col("std_error")
    out = rows.groupBy(*by).agg((F.sum(w * e) / F.nullif(F.sum(w), F.lit(0.0))).alias("estimate"), (F.sqrt(F.sum(w * w * s * s)) / F.nullif(F.sum(w), F.lit(0.0))).alias("std_error"))
    return out.withColumn("lower", F.col("estimate") - 1.96 * F.col("std_error")).withColumn("upper", F.col("estimate") + 1.96 * F.col("std_error"))
