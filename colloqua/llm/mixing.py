"""A mix of documents whose token shares follow given targets.

Documents fall into cells of source, language and topic. The cells' token totals are raked (iterative proportional fitting)
to the marginals of all three: sources to the targets, languages and topics to the corpus unless given otherwise. A cell's
raked total over its own total is the number of times each of its documents is expected; it never exceeds the ``max_repeats``
of the source, and what a capped cell cannot give goes to the others in the next round. A document is then used the whole
part of that number and once more with the probability of the rest, decided by a hash of its id, so the sample needs no
shuffle and comes out the same on every run. The size of the mix is the largest for which every source can reach its share.

Only cell totals reach the driver; their number is at most the product of three vocabularies, of which that of languages is closed
(two letters). Texts are tokenised once; the stored rows serve the factors of the subjects, the cells and the sample.

Defined results: sources are matched without case, spaces and signs; documents of unknown or null source or without text are
left out; a null language is a group of its own; repeat rows of an id count once; a source without documents gets nothing and
the mix is sized by the others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.llm.subjects import BATCH, Factors, _flat, features, mixtures
from colloqua.session import checkpoint

#: Vocabulary file of the tokenizer that sizes are counted with, and its splitting pattern (a fixed value).
VOCABULARY = os.environ.get("COLLOQUA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 200
#: Cells up to which their uses are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 200_000


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"(?U)[\W_]+", "_")


def prepared(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Stored documents with source, lang and size in tokens, as ``subjects.fit`` reads them. The vocabulary is read on the driver."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    made: dict = {}

    def tokens(texts: list[str]) -> list[int]:
        enc = made.get("encoding") or made.setdefault("encoding", _encoding(shared.value))
        return [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]

    low = F.lower(F.trim("lang"))
    lang = F.when(low.rlike("^[a-z]{2}([-_].*)?$"), F.substring(low, 1, 2)).otherwise("und")
    return features(documents.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce(lang, F.lit("und")).alias("lang"), "text"), {"doc_id": "long", "source": "string", "lang": "string"}, tokens)


def described(rows: DataFrame, factors: Factors) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every stored document of a source; of repeat rows the greatest."""
    shared = rows.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        k, names = len(f.subjects), np.array([*f.subjects, "none"], dtype=object)
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH]
                w = mixtures(f.h, *_flat(part, f.idf))[:, :k]
                topic = np.where(w.max(axis=1) > 0.02, w.argmax(axis=1), k) if k else np.zeros(len(part), int)
                yield part[["doc_id", "source", "lang"]].assign(topic=names[topic], tokens=part["size"])

    picked = rows.filter("slots is not null and doc_id is not null and source is not null").select("doc_id", "source", "lang", "size", "slots", "counts")
    out = picked.mapInPandas(run, "doc_id long, source string, lang string, topic string, tokens long")
    return out.groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "lang", "topic")).alias("m")).select("doc_id", "m.source", "m.lang", "m.topic", "m.tokens")


def rake(cells: pd.DataFrame, targets: dict[str, float], repeats: dict[str, int], langs: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> np.ndarray:
    """Expected uses of a document of each cell. ``cells``: source, lang, topic, tokens."""
    have = cells["tokens"].to_numpy(dtype=float)
    if not len(have) or not have.sum():
        return np.zeros(len(have))
    cap = have * cells["source"].map(repeats).to_numpy(dtype=float)
    own = cells.groupby("source")["tokens"].sum()
    possible = {s: t for s, t in targets.items() if t > 0 and own.get(s, 0) > 0}
    norm = sum(possible.values())
    total = min(own[s] * repeats[s] / (t / norm) for s, t in possible.items())
    share = lambda c: cells.groupby(c)["tokens"].sum().div(have.sum()).to_dict()
    margins = [("lang", langs or share("lang")), ("topic", topics or share("topic")), ("source", {s: t / norm for s, t in possible.items()})]
    x = have.copy()
    for _ in range(ROUNDS):
        for column, want in margins:
            names = cells[column].to_numpy()
            for name, s in want.items():
                at = names == name
                free, goal = at.copy(), s * total
                for _ in range(50):  # cells at their cap keep it, the others share the rest
                    fixed = x[at & ~free].sum()
                    if not free.any() or x[free].sum() <= 0:
                        break
                    x[free] *= max(goal - fixed, 0.0) / x[free].sum()
                    over = free & (x > cap)
                    if not over.any():
                        break
                    x[over] = cap[over]
                    free &= ~over
        if all(abs(x[cells[c].to_numpy() == n].sum() - s * total) <= 1e-6 * total for c, want in margins for n, s in want.items()):
            break
    return np.minimum(x, cap) / np.maximum(have, 1.0)


def mix(stored: DataFrame, targets: DataFrame, factors: Factors, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, tokens, copies of every document used at least once."""
    wanted = targets.filter("source is not null").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect()
    share, repeats = {r["source"]: r["target_share"] for r in wanted}, {r["source"]: r["max_repeats"] for r in wanted}
    rows = checkpoint(described(stored, factors).filter(F.col("source").isin(list(share))))
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    cells = cells.sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    cells["uses"] = rake(cells, share, repeats)
    table = rows.sparkSession.createDataFrame(cells[["source", "lang", "topic", "uses"]], "source string, lang string, topic string, uses double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(F.col("uses") + 1e-9)
    copies = (whole + F.when(chance < F.col("uses") - whole, 1).otherwise(0)).cast("int")
    placed = rows.join(F.broadcast(table) if len(cells) <= BROADCAST_CELLS else table, ["source", "lang", "topic"]).withColumn("copies", copies)
    return placed.filter("copies > 0").select("doc_id", "source", "lang", "topic", "tokens", "copies")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("total"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = want.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row of totals
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
