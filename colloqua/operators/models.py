"""Models fitted to sufficient statistics: the cluster only aggregates, small systems are solved on what is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers 1..k by Ward's minimum variance with squared updates; for tables of topics, not of rows."""
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2).astype(float)
    np.fill_diagonal(d, np.inf)
    members, size = {i: [i] for i in range(n)}, np.ones(n)
    while len(members) > max(k, 1):
        live = sorted(members)
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        i, j = sorted((live[a], live[b]))
        for m in live:
            if m not in (i, j):
                t = size[i] + size[j] + size[m]
                d[i, m] = d[m, i] = ((size[i] + size[m]) * d[i, m] + (size[j] + size[m]) * d[j, m] - size[m] * d[i, j]) / t
        size[i] += size[j]
        members[i] += members.pop(j)
        d[j], d[:, j] = np.inf, np.inf
    out = np.zeros(n, int)
    for c, i in enumerate(sorted(members, key=lambda i: min(members[i])), 1):
        out[members[i]] = c
    return out


def gibbs(rows: DataFrame, chains: int = 4, iterations: int = 1000, warmup: int = 250, seed: int = 123) -> DataFrame:
    """Draws of ``value ~ 0 + topic + (1 | conv_id)`` per metric: metric, topic, chain, draw, value.

    Priors: standard normal on topic effects, exponential on both scales (Metropolis steps on their logarithms). The data enter
    through n, sum and sum of squares by metric, topic and number of conversations of that size, so a conversation effect is
    integrated out and what a task holds is a table of group sizes, whatever the number of rows.
    """
    cells = rows.groupBy("metric", "topic", "conv_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    sizes = cells.filter("n > 0").groupBy("metric", "topic", "n").agg(F.count("*").alias("m"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"))
    each = sizes.crossJoin(rows.sparkSession.range(chains).select(F.col("id").cast("int").alias("chain")))  # a few chains

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["chain"].iloc[0])])
        topics = sorted(pdf["topic"].unique())
        t = pdf["topic"].map({x: i for i, x in enumerate(topics)}).to_numpy()
        n, m, s, s2, q = (pdf[c].to_numpy(dtype=float) for c in ("n", "m", "s", "s2", "q"))

        def loglik(mu: np.ndarray, sd: float, sigma: float) -> float:
            v, mt = sigma**2 + n * sd**2, mu[t]
            within = (q - s2 / n) / sigma**2
            between = (s2 - 2 * n * mt * s + m * (n * mt) ** 2) / n / v
            return float(-0.5 * (m * ((n - 1) * np.log(sigma**2) + np.log(v)) + within + between).sum())

        mu, sd, sigma, out = np.zeros(len(topics)), 0.5, 1.0, []
        for it in range(iterations):
            v = sigma**2 + n * sd**2
            precision = np.bincount(t, m * n / v, len(topics)) + 1.0
            mu = rng.normal(np.bincount(t, s / v, len(topics)) / precision, 1 / np.sqrt(precision))
            for which in (0, 1):
                new = [sd, sigma]
                new[which] *= np.exp(0.15 * rng.normal())
                gain = loglik(mu, *new) - loglik(mu, sd, sigma) - (new[which] - (sd, sigma)[which]) + np.log(new[which] / (sd, sigma)[which])
                if np.log(rng.random()) < gain:
                    sd, sigma = new
            if it >= warmup:
                out += [(pdf["metric"].iloc[0], x, int(pdf["chain"].iloc[0]), it - warmup, b) for x, b in zip([*topics, ".conv_sd", ".residual_sd"], [*mu, sd, sigma])]
        return pd.DataFrame(out, columns=["metric", "topic", "chain", "draw", "value"])

    return each.groupBy("metric", "chain").applyInPandas(run, "metric string, topic string, chain int, draw int, value double")


def convergence(draws: DataFrame) -> DataFrame:
    """metric, topic, rhat, ess of each parameter, from moments of the chains."""
    half = draws.withColumn("half", F.col("draw") % 2)
    chains = half.groupBy("metric", "topic", "chain", "half").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    across = chains.groupBy("metric", "topic").agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.count("*").alias("c"))
    total = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    return across.select("metric", "topic", F.sqrt(total / F.nullif("w", F.lit(0.0))).alias("rhat"), F.least(F.col("n") * F.col("c"), F.col("c") * total / F.nullif("b", F.lit(0.0))).alias("ess"))


def predictive(draws: DataFrame, rows: DataFrame, bins: int = 20, most: int = 100) -> DataFrame:
    """metric, bin, observed and replicated shares: a histogram of ``value`` against what ``most`` posterior draws predict.

    A topic's rows are normal around its effect with both scales, so a draw's share in a bin is exact and nothing is simulated.
    """
    from math import erf, sqrt

    edges = np.linspace(-3, 3, bins + 1)[1:-1].tolist()
    at = F.lit(0)
    for e in edges:
        at = at + (F.col("value") > e).cast("int")
    seen = rows.filter("value is not null").groupBy("metric", "topic", at.alias("bin")).agg(F.count("*").alias("n"))
    kept = draws.filter((F.col("chain") == 0) & (F.col("draw") < most))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = max(left["n"].sum(), 1)
        observed = left.groupby("bin")["n"].sum().reindex(range(bins), fill_value=0) / total
        weight = left.groupby("topic")["n"].sum() / total
        wide = right.pivot(index="draw", columns="topic", values="value")
        sd = np.sqrt(wide[".conv_sd"] ** 2 + wide[".residual_sd"] ** 2)
        below = lambda e: sum(w * np.mean([0.5 * (1 + erf((e - m) / (s * sqrt(2)))) for m, s in zip(wide[t], sd)]) for t, w in weight.items() if t in wide)
        cuts = np.array([0.0, *map(below, edges), 1.0])
        return pd.DataFrame({"metric": key[0], "bin": range(bins), "observed": observed.to_numpy(), "replicated": np.diff(cuts)})

    return seen.groupBy("metric").cogroup(kept.groupBy("metric")).applyInPandas(run, "metric string, bin int, observed double, replicated double")


def smooth(rows: DataFrame, by: str, x: str, y: str, knots: int = 8, penalty: float = 1.0) -> DataFrame:
    """Penalised spline of ``y`` on ``x`` for each value of ``by``: by, x, fit, std_error.

    Truncated lines with a ridge on their slopes. Rows are first aggregated to n, mean and sum of squares per value of ``x``
    (discretised covariate), so a group's system is as small as its number of different turns.
    """
    cells = rows.filter(F.col(y).isNotNull()).groupBy(by, x).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.sum(F.col(y) * F.col(y)).alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        t, n, m = pdf[x].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float), pdf["m"].to_numpy(dtype=float)
        at = np.unique(np.quantile(t, np.linspace(0, 1, knots + 2)[1:-1]))
        base = np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0) for k in at]])
        ridge = np.diag([1e-9, 1e-9, *[penalty] * len(at)])
        inverse = np.linalg.inv(base.T @ (n[:, None] * base) + ridge)
        beta = inverse @ base.T @ (n * m)
        fit = base @ beta
        left = max(float((pdf["q"] - 2 * n * m * fit + n * fit**2).sum()), 0.0) / max(n.sum() - base.shape[1], 1.0)
        return pd.DataFrame({by: pdf[by], x: pdf[x], "fit": fit, "std_error": np.sqrt(left * np.einsum("ij,jk,ik->i", base, inverse, base))})

    kind = dict(rows.dtypes)
    return cells.groupBy(by).applyInPandas(run, f"`{by}` {kind[by]}, `{x}` {kind[x]}, fit double, std_error double")


def _hinges(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([t, *[np.maximum(t - k, 0) for k in knots]])


def additive(rows: DataFrame, knots: int = 8, own_knots: int = 4, penalty: float = 1.0, turns: int = 20) -> DataFrame:
    """``value ~ 0 + topic x direction + s(turn) + s(turn, topic)`` per metric by penalised normal equations; columns metric, topic,
    direction, abs_turn of ``rows``. Conversation effects are not modelled.

    Rows are first aggregated to n, mean and sum of squares per topic, direction and turn, so a metric's system is as small as
    those. Returned: kind ``term`` (one row a topic and direction: estimate, std_error; one a smooth: its effective degrees of freedom as
    estimate) and kind ``grid`` (fit of every topic, direction and turn up to ``turns``; ``shared`` is the fit without the topic's own curve).
    """
    cells = rows.filter("value is not null and topic is not null").groupBy("metric", "topic", "direction", "abs_turn").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("q"))
    names = ("metric", "kind", "topic", "direction", "abs_turn", "estimate", "std_error", "shared")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        topics, ways = sorted(pdf["topic"].unique()), sorted(pdf["direction"].unique())
        t, n, m = pdf["abs_turn"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float), pdf["m"].to_numpy(dtype=float)
        at, own_at = (np.unique(np.quantile(t, np.linspace(0, 1, k + 2)[1:-1])) for k in (knots, own_knots))

        def basis(topic: np.ndarray, way: np.ndarray, turn: np.ndarray) -> np.ndarray:
            group = (topic[:, None] * len(ways) + way[:, None] == np.arange(len(topics) * len(ways))).astype(float)
            own = _hinges(turn, own_at)
            return np.hstack([group, _hinges(turn, at), *[own * (topic == i)[:, None] for i in range(len(topics))]])

        tid, wid = pdf["topic"].map({x: i for i, x in enumerate(topics)}).to_numpy(), pdf["direction"].map({x: i for i, x in enumerate(ways)}).to_numpy()
        x, groups, smooth_ = basis(tid, wid, t), len(topics) * len(ways), 1 + len(at)
        ridge = np.concatenate([np.full(groups, 1e-6), [1e-6], np.full(len(at), penalty), np.full(len(topics) * (1 + len(own_at)), 4 * penalty)])
        inverse = np.linalg.inv(x.T @ (n[:, None] * x) + np.diag(ridge))
        beta = inverse @ (x.T @ (n * m))
        fit = x @ beta
        scale = max(float((pdf["q"].to_numpy() - 2 * n * m * fit + n * fit**2).sum()), 0.0) / max(n.sum() - groups - smooth_, 1.0)
        edf = np.einsum("ij,ji->i", inverse, x.T @ (n[:, None] * x))
        se, metric, out = np.sqrt(scale * np.diag(inverse)), pdf["metric"].iloc[0], []
        for i, topic in enumerate(topics):
            for j, way in enumerate(ways):
                out.append((metric, "term", topic, way, None, beta[i * len(ways) + j], se[i * len(ways) + j], None))
        out.append((metric, "term", "s(turn)", None, None, float(edf[groups : groups + smooth_].sum()), None, None))
        out.append((metric, "term", "s(turn, topic)", None, None, float(edf[groups + smooth_ :].sum()), None, None))
        g = np.array([(i, j, k) for i in range(len(topics)) for j in range(len(ways)) for k in range(1, turns + 1)])
        b = basis(g[:, 0], g[:, 1], g[:, 2].astype(float))
        curve, error = b @ beta, np.sqrt(scale * np.einsum("ij,jk,ik->i", b, inverse, b))
        shared = b[:, : groups + smooth_] @ beta[: groups + smooth_]
        out += [(metric, "grid", topics[i], ways[j], int(k), float(c), float(e), float(h)) for (i, j, k), c, e, h in zip(g, curve, error, shared)]
        return pd.DataFrame(out, columns=names).astype({"abs_turn": "Int64"})

    return cells.groupBy("metric").applyInPandas(run, "metric string, kind string, topic string, direction string, abs_turn long, estimate double, std_error double, shared double")


def clustered(trajectories: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Trajectories with their topic's cluster (``Unclustered`` without one) and number of conversations; both tables have a row a topic."""
    out = trajectories.join(clusters, "topic", "left").join(sizes, "topic", "left")
    return out.withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("Unclustered")))


def topic_model(messages: DataFrame, k: int = 30, words: int = 9, iterations: int = 15, seed: int = 7) -> DataFrame:
    """conv_id, view, topic_id, topic_score, keywords of the views user, assistant and combined; ``messages``: conv_id, role, text.

    Each view has its own seeded topic model, fitted by expectation maximisation: every pass reads every conversation. The
    terms are all words of three letters or more without English stop words. They are counted by message and summed, so no text
    is gathered. Conversations without user or without assistant messages are left out, as in ``documents_of``; one without
    terms has topic 0 with score 0. The driver holds the vocabulary and ``k`` numbers a term.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import StopWordsRemover, StringIndexer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors, VectorUDT

    from colloqua.session import checkpoint

    spark = messages.sparkSession
    roles = messages.groupBy("conv_id").agg(F.collect_set("role").alias("r")).filter(F.array_contains("r", "user") & F.array_contains("r", "assistant")).select("conv_id")
    split = messages.select("conv_id", "role", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)).alias("_all"))
    kept = StopWordsRemover(inputCol="_all", outputCol="_words").transform(split)
    counts = kept.select("conv_id", "role", F.explode("_words").alias("term")).groupBy("conv_id", "role", "term").agg(F.count("*").alias("n"))
    counts = checkpoint(counts.join(roles, "conv_id", "left_semi"))
    if counts.isEmpty():
        return roles.crossJoin(spark.createDataFrame([(v,) for v in ("user", "assistant", "combined")], "view string")).select("conv_id", "view", F.lit(0).alias("topic_id"), F.lit(0.0).alias("topic_score"), F.lit(None).cast("string").alias("keywords"))
    index = StringIndexer(inputCol="term", outputCol="i").fit(counts)
    listed = index.labels
    numbered = index.transform(counts).select("conv_id", "role", F.col("i").cast("int").alias("i"), "n")
    size = len(listed)
    vector = F.udf(lambda cells: Vectors.sparse(size, [(c["i"], float(c["n"])) for c in cells or ()]), VectorUDT())
    out = None
    for view, of in (("user", ["user"]), ("assistant", ["assistant"]), ("combined", ["user", "assistant"])):
        cells = numbered.filter(F.col("role").isin(of)).groupBy("conv_id", "i").agg(F.sum("n").alias("n"))
        docs = cells.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("cells"))
        docs = checkpoint(roles.join(docs, "conv_id", "left").select("conv_id", F.size(F.coalesce("cells", F.array())).alias("terms"), vector("cells").alias("_v")))
        fitted = docs.filter("terms > 0")
        if fitted.isEmpty():
            named = docs.select("conv_id", F.lit(0).alias("topic_id"), F.lit(0.0).alias("topic_score"), F.lit(None).cast("string").alias("keywords"))
        else:
            model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="_v", optimizer="em").fit(fitted)
            rows = [(r["topic"], " / ".join(listed[i] for i in r["termIndices"])) for r in model.describeTopics(words).collect()]  # k rows
            names = spark.createDataFrame(rows, "topic_id int, keywords string")
            v = vector_to_array("topicDistribution")
            scored = model.transform(docs).withColumn("topic_score", F.array_max(v)).withColumn("topic_id", (F.array_position(v, F.col("topic_score")) - 1).cast("int"))
            named = scored.join(F.broadcast(names), "topic_id", "left").select("conv_id", "topic_id", "topic_score", "keywords")
        named = named.select("conv_id", F.lit(view).alias("view"), "topic_id", "topic_score", "keywords")
        out = named if out is None else out.unionByName(named)
    return out
