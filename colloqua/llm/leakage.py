"""Evaluation items found in corpus documents, in full or in passages.

Every item is cut into windows of several sizes, up to most of the item (``SIZES``), and so is every document at every word. A
window is a 64-bit SimHash of its words (rare ones weigh double). Each size has the Hamming radius that an alteration moves it
by: a long window keeps its print when words change, a short one only meets unaltered passages. Fingerprints within a radius r
agree in one of four blocks of 16 bits but for r // 4 bits, so the items' windows are filed under every block value that few bits
away and looking up the four blocks of a document window finds all of them.

Candidates are verified exactly: the five-word shingles that item and document share are laid over the item, short gaps are
closed, and a piece counts if it has at least ``PIECE`` words and its weighted share of equal words (weights: rarity among the
items) reaches ``DENSITY``. Pieces of one item are added up. Sentences that several items share are instructions and count for
nothing.

The items are the stated query set. What is counted over them (shared sentences, rarity) covers all of them, then they are
indexed and broadcast in slices of ``SLICE``; every slice scans the corpus once. Nothing of the corpus is shuffled but the hits.

Defined results: items or documents that are null, empty or shorter than a window match nothing; documents are read whole;
repeat rows count once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloqua.session import spread

BITS, BLOCKS = 64, 4
_BLOCK = BITS // BLOCKS
#: Words of a window: Hamming radius, words between two windows of an item. One altered word of n moves about 64 arccos(1 - 1/n) / pi bits.
SIZES = {10: (3, 1), 20: (7, 4), 40: (11, 10)}
#: Words of a shingle of the exact verification.
WINDOW = 5
#: Items that share a sentence from which it is an instruction.
SHARED = 3
#: Gap between matching shingles that is still an alteration; least words of a piece; least weighted share of equal words.
GAP, PIECE, DENSITY = 3, 8, 0.75
#: Least share of an item's words.
SHARE = 1 / 3
#: Items of one broadcast index.
SLICE = 20_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


#: Characters that nobody sees: format characters such as zero-width spaces and soft hyphens.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")


def words(text: str) -> list[str]:
    """Words in one case, without unseen characters, entities and compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    return _WORD.findall(text.casefold())


@dataclass
class Statistics:
    """Of all items: how many there are, how many share a sentence (by hash) and how many hold a word."""

    n: int
    sentences: Counter
    df: Counter


def _sentences(text: str | None) -> list[tuple[str, ...]]:
    return [tuple(words(s)) for s in _SENTENCE.split(text or "")]


def statistics(texts: Iterable[str]) -> Statistics:
    sentences, df, n = Counter(), Counter(), 0
    for t in texts:
        split = _sentences(t)
        sentences.update({hash(s) for s in split})
        df.update({w for s in split for w in s})
        n += 1
    return Statistics(n, sentences, df)


def own_words(text: str, stats: Statistics) -> list[str]:
    """The words of an item without the sentences that ``SHARED`` or more items have."""
    return [w for s in _sentences(text) if stats.sentences[hash(s)] < SHARED for w in s]


class _Signs(dict):
    """Word -> row of a table of 64 signs times the word's weight."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common, self.table, self.words = common, np.zeros((4096, BITS), np.int8), []

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(word)], dtype=">u8").view(np.uint8))
        self.table[i] = (bits.astype(np.int8) * 2 - 1) * (1 if word in self.common else 2)
        self[word] = i
        return i


def fingerprints(ids: np.ndarray, signs: _Signs, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words of ``ids``, by adding windows of powers of two; sums up to 2 x 63 fit a byte."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    part, total, have, n = signs.table[ids], None, 0, 1
    while n <= size:
        if size & n:
            total = part if total is None else total[: len(total) - n] + part[have : have + len(total) - n]
            have += n
        part, n = part[:-n] + part[n:], 2 * n
    return np.packbits(total[: len(ids) - size + 1] >= 0, axis=1).view(">u8").ravel().astype(np.uint64)


@dataclass
class Windows:
    """Item windows of one size, filed by block values."""

    size: int
    radius: int
    prints: np.ndarray
    item: np.ndarray  # position of the item in the index
    blocks: list[tuple[np.ndarray, np.ndarray]]  # per block: windows by value, start of each value


@dataclass
class Index:
    ids: list[int]  # item ids
    texts: list[list[str]]
    weights: list[np.ndarray]  # rarity of each word of each item
    shingles: list[dict[tuple[str, ...], list[int]]]
    common: frozenset[str]
    windows: list[Windows]


def _masks(bits: int) -> np.ndarray:
    """All block values with at most ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(_BLOCK), n)], dtype=np.int64)


def _filed(size: int, radius: int, prints: np.ndarray, item: np.ndarray) -> Windows:
    masks, blocks = _masks(radius // BLOCKS), []
    for b in range(BLOCKS):
        value = ((prints >> np.uint64(b * _BLOCK)) & np.uint64((1 << _BLOCK) - 1)).astype(np.int64)
        near_values = (value[:, None] ^ masks).ravel()
        order = np.argsort(near_values, kind="stable")
        blocks.append(((order // len(masks)).astype(np.int32), np.searchsorted(near_values[order], np.arange((1 << _BLOCK) + 1))))
    return Windows(size, radius, prints, item, blocks)


def build(items: dict[int, str], stats: Statistics | None = None) -> Index:
    """Index of ``items``; ``stats`` of all items, if these are only some of them."""
    stats = stats or statistics(items.values())
    own = {i: ws for i, t in sorted(items.items()) if len(ws := own_words(t, stats)) >= WINDOW}
    n = max(1, stats.n)
    common = frozenset(w for ws in own.values() for w in ws if stats.df[w] >= 0.1 * n)
    signs, windows = _Signs(common), []
    flat = [np.array([signs[w] for w in ws]) for ws in own.values()]
    for size, (radius, step) in SIZES.items():
        prints = [fingerprints(x, signs, size)[::step] for x in flat]
        item = np.repeat(np.arange(len(flat)), [len(p) for p in prints])
        windows.append(_filed(size, radius, np.concatenate(prints) if prints else np.zeros(0, np.uint64), item))
    shingles: list[dict[tuple[str, ...], list[int]]] = []
    for ws in own.values():
        at: dict[tuple[str, ...], list[int]] = {}
        for p in range(len(ws) - WINDOW + 1):
            at.setdefault(tuple(ws[p : p + WINDOW]), []).append(p)
        shingles.append(at)
    weights = [np.array([np.log(1 + n / stats.df[w]) for w in ws]) for ws in own.values()]
    return Index(list(own), list(own.values()), weights, shingles, common, windows)


def near(index: Windows, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query window, item window) of all pairs within the radius, some of them more than once."""
    qs, ws = [], []
    for b, (order, start) in enumerate(index.blocks):
        value = ((prints >> np.uint64(b * _BLOCK)) & np.uint64((1 << _BLOCK) - 1)).astype(np.int64)
        lo, n = start[value], start[value + 1] - start[value]
        some = np.flatnonzero(n)
        lo, n = lo[some], n[some]
        q = np.repeat(some, n)
        first = np.repeat(lo - (np.cumsum(n) - n), n)
        w = order[first + np.arange(len(q))] if len(q) else np.zeros(0, np.int32)
        hit = np.bitwise_count(prints[q] ^ index.prints[w]) <= index.radius
        qs.append(q[hit]), ws.append(w[hit])
    return np.concatenate(qs), np.concatenate(ws)


def share(index: Index, k: int, doc: list[str]) -> float:
    """Share of item ``k``'s words in pieces of ``doc``."""
    item, weight, shingles = index.texts[k], index.weights[k], index.shingles[k]
    cover = np.zeros(len(item), bool)
    for p in range(len(doc) - WINDOW + 1):
        for q in shingles.get(tuple(doc[p : p + WINDOW]), ()):
            cover[q : q + WINDOW] = True
    at = np.flatnonzero(cover)
    if not len(at):
        return 0.0
    total = 0
    for run in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1):
        lo, hi = run[0], run[-1] + 1
        if hi - lo >= PIECE and (weight[lo:hi] * cover[lo:hi]).sum() >= DENSITY * weight[lo:hi].sum():
            total += hi - lo
    return total / len(item)


def candidates(index: Index, base: np.ndarray, ids: np.ndarray, signs: _Signs) -> list[tuple[int, int]]:
    """(text, item) pairs with near windows; ``base``: first word of each text and the end, ``ids``: all words."""
    pairs = []
    for windows in index.windows:
        if not len(windows.prints):
            continue
        q, w = near(windows, fingerprints(ids, signs, windows.size))
        owner = np.searchsorted(base, q, side="right") - 1
        inside = q + windows.size <= base[owner + 1]  # windows over the end of a text are none
        pairs.append(owner[inside] * len(index.ids) + windows.item[w[inside]])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return list(zip((both // max(1, len(index.ids))).tolist(), (both % max(1, len(index.ids))).tolist()))


def scan(index: Index, texts: list[str], signs: _Signs) -> list[tuple[int, int, float]]:
    """(text number, item id, share of the item's words) of every text that holds enough of an item."""
    docs = [words(t) if t else [] for t in texts]
    ids = np.array([signs[w] for d in docs for w in d], dtype=np.int64)
    if not len(ids) or not index.ids:
        return []
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = [(d, k, share(index, k, docs[d])) for d, k in candidates(index, base, ids, signs)]
    return [(d, index.ids[k], s) for d, k, s in found if s >= SHARE]


def found(documents: DataFrame, benchmark: DataFrame, size: int = SLICE) -> DataFrame:
    """doc_id, item_id, share of every document that holds at least a third of an item; ``size``: items of a slice."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id")
    stats = statistics(r["text"] for r in rows.toLocalIterator())
    picked = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    every, out = rows.toLocalIterator(), None
    while (part := {r["item_id"]: r["text"] for r in islice(every, size)}) or out is None:
        shared = documents.sparkSession.sparkContext.broadcast(build(part, stats))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, signs = shared.value, _Signs(shared.value.common)
            for pdf in batches:
                if len(signs) > 200_000:
                    signs = _Signs(index.common)
                ids, texts, res = list(pdf["doc_id"]), list(pdf["text"]), []
                for lo in range(0, len(texts), 200):
                    res += [(ids[lo + d], k, s) for d, k, s in scan(index, texts[lo : lo + 200], signs)]
                if res:
                    yield pd.DataFrame(res, columns=["doc_id", "item_id", "share"])

        hits = spread(picked).mapInPandas(run, "doc_id long, item_id long, share double")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
