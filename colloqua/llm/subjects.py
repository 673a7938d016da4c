"""Subject areas of documents by anchored non-negative matrix factorisation.

The documents x terms matrix (counts times rarity, terms in ``SLOTS`` hashed slots) is factored by alternating
multiplicative updates that lower the Kullback-Leibler divergence. Each subject owns one component, seeded with the terms
that documents labelled with it hold more often than others; further components take up what belongs to no subject.

Texts are read once: their sparse term counts are written in the shared folder and every pass reads those. A pass updates every
document's mixture in its own task and sums the update of the term weights by slot, so the driver only ever holds
``components x SLOTS`` numbers. All documents take part in the counts and in every pass; only the seeds come from a bounded sample
of the hand labels (``LABELLED``).

A subject is reported where it makes up at least ``SHARE`` of a document's subject mass.

Defined results: null and empty texts have no subject; labels are matched without case, spaces and signs, unknown ones are
ignored; repeat rows count once; documents are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloqua.session import checkpoint, spread

SLOTS = 1 << 16
#: Most labelled documents that seeds are taken from.
LABELLED = 20_000
#: Components without subject, passes over the corpus, updates of a mixture within a pass and for the result.
REST, PASSES, PASS_INNER, INNER = 4, 3, 6, 12
#: Least share of a document's subject mass; least documents that a term occurs in.
SHARE, LEAST_DF = 0.2, 3
_TERM = re.compile(r"[^\W\d_]{3,}")


class _Slots(dict):
    def __missing__(self, term: str) -> int:
        s = zlib.crc32(term.encode()) & (SLOTS - 1)
        if len(self) > 300_000:
            self.clear()
        self[term] = s
        return s


#: Documents that are worked on at a time, and matrix entries of a block of documents of like length.
BATCH, BLOCK = 2000, 1 << 16


def counted(text: str, slots: _Slots) -> tuple[list[int], list[int]]:
    """Slots and counts of a text's terms."""
    c = Counter(map(slots.__getitem__, _TERM.findall(text.lower())))
    return list(c.keys()), list(c.values())


def features(documents: DataFrame, columns: dict[str, str], measure: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Written once: ``columns`` (name: type) of every document with text, its ``size`` by ``measure``, slots and counts.

    A row without slots but with ``df`` comes last from every task: document frequencies of that task's documents, the number of
    documents behind them.
    """
    names = list(columns)
    picked = documents.filter("text is not null").select(*names, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, df = _Slots(), np.zeros(SLOTS + 1, np.int64)
        for pdf in batches:
            both = [counted(t, slots) for t in pdf["text"]]
            for s, _ in both:
                df[s] += 1
            df[SLOTS] += len(both)
            out = pdf[names].assign(size=measure(list(pdf["text"])) if measure else 0, slots=[s for s, _ in both], counts=[c for _, c in both], df=None)
            yield out
        yield pd.DataFrame({**{n: pd.Series([None], dtype=object) for n in names}, "size": [0], "slots": [None], "counts": [None], "df": [df.tolist()]})

    schema = ", ".join(f"{n} {t}" for n, t in columns.items()) + ", size long, slots array<int>, counts array<int>, df array<long>"
    return checkpoint(spread(picked).mapInPandas(run, schema))


def _flat(pdf: pd.DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of entries of each document, slot, value) of the documents, without terms of no weight."""
    n = np.array([len(s) for s in pdf["slots"]], dtype=np.int64)
    if not n.sum():
        return n, np.zeros(0, np.int64), np.zeros(0, np.float32)
    c, v = np.concatenate(list(pdf["slots"])).astype(np.int64), np.concatenate(list(pdf["counts"])).astype(np.float32)
    v = v * idf[c].astype(np.float32)
    keep = v > 0
    n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    return n, c[keep], v[keep]


def mixtures(h: np.ndarray, n: np.ndarray, c: np.ndarray, v: np.ndarray, inner: int = INNER, total: np.ndarray | None = None) -> np.ndarray:
    """Mixture of each document for fixed term weights ``h``; adds each component's part of every entry to ``total`` (slots x components).

    Documents of like length make a block, filled up with empty entries, so an update is two batched products.
    """
    k = h.shape[0]
    w = np.full((len(n), k), 1.0 / k, np.float32)
    ht = np.ascontiguousarray(h.T, dtype=np.float32)
    starts, order = np.concatenate([[0], np.cumsum(n)]), np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    lo = 0
    while lo < len(order):
        longest = n[order[lo:]]
        hi = lo + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), BLOCK, side="right")))
        docs = order[lo:hi]
        lo, width = hi, int(n[docs[-1]])
        at = starts[docs][:, None] + np.arange(width)
        empty = np.arange(width) >= n[docs][:, None]
        at[empty] = 0
        hc, x = ht[c[at]], np.where(empty, np.float32(0), v[at])
        y = w[docs]
        for _ in range(inner):
            r = x / np.maximum(np.matmul(hc, y[:, :, None])[:, :, 0], 1e-12)
            y *= np.matmul(r[:, None, :], hc)[:, 0, :]
            y /= np.maximum(y.sum(axis=1, keepdims=True), 1e-12)
        w[docs] = y
        if total is not None:
            part = hc * y[:, None, :]
            part *= (x / np.maximum(part.sum(axis=2), 1e-12))[:, :, None]
            slots = c[at][~empty]
            for j in range(k):
                total[:, j] += np.bincount(slots, part[:, :, j][~empty], SLOTS)
    return w


@dataclass
class Factors:
    subjects: list[str]
    h: np.ndarray  # components x SLOTS, rows sum to 1; subjects first
    idf: np.ndarray


def _key(name: str) -> str:
    return re.sub(r"[\W_]+", "", name.casefold())


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every slot and the number of documents, over the whole corpus."""
    total = rows.filter("df is not null").select(F.posexplode("df").alias("slot", "df")).groupBy("slot").agg(F.sum("df").alias("df")).toPandas()  # SLOTS rows
    df = np.zeros(SLOTS + 1, np.int64)
    df[total["slot"].to_numpy(dtype=np.int64)] = total["df"].to_numpy()
    return df[:SLOTS], int(df[SLOTS])


def labelled(rows: DataFrame, labels: DataFrame, subjects: list[str]) -> pd.DataFrame:
    """slots and subjects (list of positions) of at most ``LABELLED`` labelled documents."""
    known = {_key(s): i for i, s in enumerate(subjects)}
    plain = F.regexp_replace(F.lower("subject"), r"(?U)[\W_]+", "")
    clean = labels.filter("doc_id is not null and subject is not null").select("doc_id", plain.alias("subject")).filter(F.col("subject").isin(list(known)))
    sets = clean.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    total = sets.count()
    if total > LABELLED:
        sets = sets.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(0.95 * LABELLED / total * (1 << 20)))
    out = rows.filter("slots is not null").select("doc_id", "slots").join(sets, "doc_id").limit(LABELLED).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    out["subjects"] = [[known[s] for s in ss] for ss in out["subjects"]]
    return out


def seed(subjects: list[str], descriptions: list[str], df: np.ndarray, n: int, rows: pd.DataFrame, idf: np.ndarray) -> np.ndarray:
    """Initial term weights: for subjects what sets their labelled documents apart, for the rest the corpus itself."""
    slots, k = _Slots(), len(subjects)
    held = np.zeros((k, SLOTS))
    docs = np.zeros(k)
    for terms, ss in zip(rows["slots"], rows["subjects"]):
        for s in ss:
            held[s, terms] += 1.0 / len(ss)
            docs[s] += 1.0 / len(ss)
    for s, text in enumerate(descriptions):
        held[s, [slots[t] for t in _TERM.findall(f"{subjects[s]} {text or ''}".lower())]] += 0.5
    rate = held / np.maximum(docs, 1.0)[:, None]
    other = (rate.sum(axis=0) - rate) / max(k - 1, 1)
    # a term is an anchor as far as its own documents hold it more often than those of the other subjects
    lift = rate / np.maximum(rate + (k - 1) * other, 1e-9)
    h = rate * np.maximum(lift - 0.25, 0.0) ** 2 * idf + 1e-7 * (df > 0)
    rng = np.random.default_rng(11)
    rest = (df / max(n, 1))[None, :] * rng.uniform(0.8, 1.2, (REST, SLOTS)) * idf + 1e-9 * (df > 0)
    h = np.vstack([h, rest])
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1e-12)


def prepared(documents: DataFrame) -> DataFrame:
    """The stored term counts that ``fit`` and ``shares`` read."""
    return features(documents, {"doc_id": "long"})


def fit(rows: DataFrame, labels: DataFrame, areas: DataFrame, passes: int = PASSES) -> Factors:
    """Factors of the stored documents ``rows``; subjects are those of ``areas`` (subject, description)."""
    names = {r["subject"]: r["description"] for r in areas.filter("subject is not null").select("subject", "description").collect()}
    subjects = sorted(names)
    df, n = frequencies(rows)
    idf = np.where(df >= LEAST_DF, np.log(np.maximum(n, 1) / np.maximum(df, 1)), 0.0)
    h = seed(subjects, [names[s] for s in subjects], df, n, labelled(rows, labels, subjects), idf)
    sc, k = rows.sparkSession.sparkContext, h.shape[0]
    columns = [f"c{i}" for i in range(k)]
    entries = rows.filter("slots is not null").select("slots", "counts")
    for _ in range(passes):
        shared = sc.broadcast((h, idf))

        def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            h, idf = shared.value
            total = np.zeros((SLOTS, k))
            for pdf in batches:
                for lo in range(0, len(pdf), BATCH):
                    mixtures(h, *_flat(pdf.iloc[lo : lo + BATCH], idf), inner=PASS_INNER, total=total)
            at = np.flatnonzero(total.sum(axis=1))
            yield pd.DataFrame({"slot": at, **{f"c{i}": total[at, i] for i in range(k)}})

        parts = entries.mapInPandas(update, "slot int, " + ", ".join(f"{c} double" for c in columns))
        summed = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # at most SLOTS rows
        new = np.zeros_like(h)
        new[:, summed["slot"].to_numpy(dtype=np.int64)] = summed[columns].to_numpy().T
        h = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-12)
        shared.unpersist()
    return Factors(subjects, h, idf)


def shares(rows: DataFrame, factors: Factors) -> DataFrame:
    """doc_id, subject, share of every subject's part in a stored document's subject mass."""
    shared = rows.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        k, names = len(f.subjects), np.array(f.subjects, dtype=object)
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH]
                n, c, v = _flat(part, f.idf)
                w = mixtures(f.h, n, c, v)[:, :k]
                mass = w.sum(axis=1)
                d, s = np.nonzero((w >= 0.05 * mass[:, None]) & (mass > 0.02)[:, None] & (n > 0)[:, None])
                if len(d):
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[d], "subject": names[s], "share": (w[d, s] / mass[d]).astype(float)})

    return rows.filter("slots is not null and doc_id is not null").select("doc_id", "slots", "counts").mapInPandas(run, "doc_id long, subject string, share double")


def found(rows: DataFrame, factors: Factors, share: float = SHARE) -> DataFrame:
    """doc_id, subject, share of the subjects that make up at least ``share`` of a stored document."""
    hits = shares(rows, factors).filter(F.col("share") >= share)
    return hits.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
