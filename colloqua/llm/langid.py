"""Language of each message, of each one-language segment and of each chat.

A text is the average of hashed subword embeddings (character 3- to 5-grams of each word and the word itself) and a linear
softmax reads the language off the average. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled messages. Stored labels may be wrong and a message may mix languages, so every different
sentence first gets a language of its own: how often it stands under each label (weighted back to the corpus, read through the
confusion of labels and languages) and its words' counts in all other sentences are brought together by expectation
maximisation, starting from a few common words of each language. Sentences that stay unsure are not learnt. Held-out sentences,
with the languages found that way and not by the model, set the temperature, so the confidence is a probability, and the
rejection threshold. Embedding times softmax matrix is one score row per hash bucket, so what is broadcast has a fixed size.

Segments: sentences and lines are scored, a Viterbi pass with a price for each change of language labels them, and
neighbours of one language are joined. Code, addresses of the web, e-mail addresses and numbers are not scored; garbled text
is scored as restored.

Defined results: null or blank texts and texts below the confidence threshold have no language (null) and give no row; labels
null, empty, ``und`` and ``unknown`` are missing; case and region suffixes of labels do not matter; repeat rows count once;
texts are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.llm.conversations import clean_role
from colloqua.llm.encoding import mend
from colloqua.session import spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru")
BUCKETS, DIM = 1 << 16, 16
#: Bound on labelled training rows per language.
PER_LANGUAGE = 2000
#: Words a worker keeps scores for at most.
CACHE = 200_000
#: Words and confidence below which a segment joins its neighbours (signatures, data lines).
LEAST_WORDS, LEAST_SURE = 4, 0.85
#: Common words of each language (fixed values), what one of them counts beside the corpus, and the probability from which a
#: sentence's language is settled.
COMMON = {
    "en": "the and of to is that for with you it this are not have what how can my one",
    "de": "der die das und ist nicht mit ein eine ich sie wie was auf für den dem wird man",
    "fr": "le la les des et est que pour avec dans pas vous je ce une sur qui mais au",
    "es": "el la los las y es que para con una no por se del cómo pero más este su",
    "pt": "o os as e é que para com uma não por se do da como mas mais isso um",
    "it": "il lo gli e è che per con una non di del della come ma più questo si un",
    "nl": "de het een en is niet met van voor dat ik je hoe wat op maar zijn er ook",
    "ru": "и в не на что с как для это по но из я он она мы так от же",
}
SEED_WEIGHT, SETTLED = 20.0, 0.95
#: Share of a word that every language is granted.
BACK = 0.02
#: Log-probability a change of language costs.
SWITCH = 4.0

#: Words of letters only; what holds a digit is a number or a code.
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)?(?!\w)")
_UNIT = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+")
_NOISE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|\S*\w\.\w+/\S*|\S+@\S+|\{\"[^\n]*\}|\[[a-z_]+\]|<[^>\s]+>", re.S)
_NOISY = re.compile(r"[`@/{\[<]")


def _clean(text: str) -> str:
    text = text if text.isascii() else mend(text).replace("\ufffd", "")
    return _NOISE.sub(" ", text) if _NOISY.search(text) else text


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    out = [zlib.crc32(w.encode())]
    for n in (3, 4, 5):
        out += [zlib.crc32(w[i : i + n].encode()) for i in range(len(w) - n + 1)]
    return [h & (BUCKETS - 1) for h in out]


@dataclass
class Model:
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float  # on held-out sentences
    languages: tuple[str, ...] = LANGUAGES


class _Index(dict):
    """Word -> row of the score table, filled as words come."""

    def __init__(self, scores: np.ndarray) -> None:
        self.scores, self.table = scores, np.zeros((1024, scores.shape[1] + 1), np.float32)

    def __missing__(self, word: str) -> int:
        g, i = _grams(word), len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i, :-1], self.table[i, -1] = self.scores[g].sum(axis=0), len(g)
        self[word] = i
        return i


class Scorer:
    """Log-probabilities of texts; scores of words are kept between batches."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, _Index(model.scores)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities, number of words) of each text; no words gives a flat distribution."""
        if len(self.index) > CACHE:
            self.index = _Index(self.model.scores)
        of, flat, counts = self.index.__getitem__, [], []
        for t in texts:
            words = _WORD.findall(t.lower())
            counts.append(len(words))
            flat.extend(map(of, words))
        n, k = np.array(counts, dtype=np.int64), len(self.model.languages)
        out = np.full((len(texts), k), -np.log(k))
        if flat:
            full = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            sums = np.add.reduceat(self.index.table[np.array(flat)], starts)
            z = (sums[:, :-1] / sums[:, -1:] + self.model.bias) / self.model.temperature
            z -= z.max(axis=1, keepdims=True)
            out[full] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out, n


def _fit(bags: list[tuple[str, ...]], y: np.ndarray, k: int, epochs: int, seed: int, balance: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on embeddings, softmax matrix and bias, averaged inputs, linearly falling rate.

    A batch first sums the subwords of each of its different words, so repeated words cost one row of a small matrix.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    grams: dict[str, list[int]] = {}
    classes = [own for c in range(k) if len(own := np.flatnonzero(y == c))]
    each = -(-len(bags) // len(classes))  # as many examples of every language, whatever the sample holds
    size, n = 128, each * len(classes) if balance else len(bags)
    steps, step = max(1, epochs * -(-n // size)), 0
    for _ in range(epochs):
        order = rng.permutation(np.concatenate([rng.choice(own, each) for own in classes]) if balance else n)
        for lo in range(0, n, size):
            pick = order[lo : lo + size]
            cols: dict[str, int] = {}
            cells = [(r, cols.setdefault(word, len(cols))) for r, i in enumerate(pick) for word in bags[i]]
            count = np.zeros((len(pick), len(cols)), np.float32)
            np.add.at(count, tuple(np.array(cells).T), 1)
            lists = [grams.get(word) or grams.setdefault(word, _grams(word)) for word in cols]
            lens = np.array([len(g) for g in lists])
            ids = np.concatenate([np.array(g) for g in lists])
            words = np.add.reduceat(emb[ids], np.concatenate([[0], np.cumsum(lens)[:-1]]))
            total = (count @ lens.astype(np.float32))[:, None]
            avg = (count @ words) / total
            z = avg @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            rate = 1 - step / steps
            step += 1
            grad = count.T @ ((p @ w.T) / total)
            w -= 0.2 * rate * (avg.T @ p)
            b -= 0.2 * rate * p.mean(axis=0)
            np.subtract.at(emb, ids, np.repeat(1.5 * rate * grad, lens, axis=0).astype(np.float32))
    return (emb @ w).astype(np.float32), b


def settled(bags: list[tuple[str, ...]], counts: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Probability of each language for each different sentence; ``counts``: weight of each stored label it was seen under.

    The words' counts are those of all other sentences, so no sentence confirms itself.
    """
    k = len(LANGUAGES)
    ids: dict[str, int] = {}
    for la in LANGUAGES:
        for word in COMMON[la].split():
            ids.setdefault(word, len(ids))
    flat = np.array([ids.setdefault(word, len(ids)) for words in bags for word in words], dtype=np.int64)
    sizes = np.array([len(words) for words in bags])
    of = np.repeat(np.arange(len(bags)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seeds = np.zeros((len(ids), k))
    for j, la in enumerate(LANGUAGES):
        seeds[[ids[word] for word in COMMON[la].split()], j] = SEED_WEIGHT
    total = counts.sum(axis=1, keepdims=True)
    confusion = np.full((k, k), 0.1 / k) + 0.9 * np.eye(k)
    post = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)
    evidence = counts / np.maximum(total, 1e-9) * np.minimum(np.log1p(total / np.maximum(total.min(), 1e-9)), 3.0)
    for _ in range(rounds):
        mass = post * total  # in rows of the corpus, so the mislabelled part of a large language stays small beside it
        words = seeds + np.stack([np.bincount(flat, mass[of, j], len(ids)) for j in range(k)], axis=1)
        share = np.maximum(words[flat] - mass[of], 0.0) / np.sqrt(words.sum(axis=0))
        rest = share.sum(axis=1, keepdims=True)
        share = np.where(rest > 0, share / np.maximum(rest, 1e-12), 1.0 / k)  # a word not seen elsewhere speaks for no language
        z = np.add.reduceat(np.log(share + BACK), starts) + evidence @ np.log(confusion).T
        z -= z.max(axis=1, keepdims=True)
        post = np.exp(z)
        post /= post.sum(axis=1, keepdims=True)
        confusion = post.T @ counts + 0.5
        confusion /= confusion.sum(axis=1, keepdims=True)
    return post


def train(texts: list[str], labels: list[str], weights: list[float] | None = None, seed: int = 7, epochs: int = 4) -> Model:
    """A model from the sentences of labelled texts; a tenth of them, held out, calibrates it. ``weights``: rows a text stands for."""
    k, seen = len(LANGUAGES), {}
    for t, lab, w in zip(texts, labels, weights if weights is not None else [1.0] * len(texts)):
        if t and lab in LANGUAGES:
            for u in _UNIT.split(_clean(t)):
                if len(words := tuple(_WORD.findall(u.lower()))) >= 3:
                    seen.setdefault(words, [0.0] * k)[LANGUAGES.index(lab)] += w
    if not seen:
        return Model(np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32), 1.0, 1.0, 0.0)
    bags = sorted(seen)
    post = settled(bags, np.array([seen[words] for words in bags]))
    sure = np.flatnonzero(post.max(axis=1) >= SETTLED)
    if not len(sure):
        sure = np.arange(len(bags))
    bags, y = [bags[i] for i in sure], post[sure].argmax(axis=1)
    held = np.random.default_rng(seed).random(len(bags)) < 0.1
    flat = [" ".join(words) for words in bags]
    keep, test = np.flatnonzero(~held), np.flatnonzero(held)
    if not len(keep):
        keep = test
    scores, b = _fit([bags[i] for i in keep], y[keep], k, max(epochs, -(-20_000 // len(keep))), seed + 1)
    temperature, threshold, accuracy = 1.0, 0.5, 0.0
    if len(test):
        best = np.inf
        for temp in (0.7, 1.0, 1.4, 2.0, 3.0):  # settled sentences are the easier ones, so the model is made no surer than this
            logp = Scorer(Model(scores, b, temp, 0.0, 0.0))([flat[i] for i in test])[0]
            loss = -logp[np.arange(len(test)), y[test]].mean()
            if loss < best:
                best, temperature, conf, right = loss, temp, np.exp(logp.max(axis=1)), logp.argmax(axis=1) == y[test]
        accuracy = float(right.mean())
        order = np.argsort(-conf)
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= 0.99)
        threshold = float(np.clip(conf[order][good[-1]] if len(good) else 0.9, 0.4, 0.9))
    return Model(scores, b, temperature, threshold, accuracy)


def label(column: Column) -> Column:
    """ISO code of a stored label, null where it is missing."""
    low = F.lower(F.split(F.trim(column), "[-_]")[0])
    return F.when(~low.isin("", "und", "unknown"), low)


def training_rows(rows: DataFrame, text: str, lang: str, key: str, per_language: int = PER_LANGUAGE) -> pd.DataFrame:
    """About ``per_language`` labelled rows of each language, chosen by the hash of their key, with the rows each stands for.

    Never more than twice ``per_language`` rows a language.
    """
    labelled = rows.select(F.col(text).alias("text"), label(F.col(lang)).alias("lang"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("h"))
    labelled = labelled.filter(F.col("lang").isin(*LANGUAGES) & (F.length("text") >= 20))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return pd.DataFrame({"text": [], "lang": [], "weight": []})
    cut = F.create_map(*[F.lit(x) for la, n in sorted(counts.items()) for x in (la, int(per_language / n * (1 << 20)) + 1)])
    picked = labelled.filter(F.col("h") < cut[F.col("lang")]).select("text", "lang", "h").limit(2 * per_language * len(LANGUAGES)).toPandas().sort_values(["h", "text"])
    picked["weight"] = picked["lang"].map({la: max(1.0, n / per_language) for la, n in counts.items()})
    return picked


def fit_model(rows: DataFrame, text: str, lang: str, key: str, per_language: int = PER_LANGUAGE) -> Model:
    sample = training_rows(rows, text, lang, key, per_language)
    return train(list(sample["text"]), list(sample["lang"]), list(sample["weight"]))


def segments(texts: list[str], scorer: Scorer) -> list[list[tuple[str, int, float]]]:
    """For each text its one-language segments: (language, characters, confidence), in order; [] where none is sure."""
    units: list[str] = []
    ends = []
    for t in texts:
        if t:
            units += [u for u in _UNIT.split(_clean(t)) if u and not u.isspace()]
        ends.append(len(units))
    out: list[list[tuple[str, int, float]]] = [[] for _ in texts]
    if not units:
        return out
    logp, n = scorer(units)
    prob, langs, k = np.exp(logp), scorer.model.languages, len(scorer.model.languages)
    # units that are short or unsure (names, data, exclamations) follow their neighbours
    sure = (n >= 3) & (prob.max(axis=1) >= scorer.model.threshold)
    evidence = np.log(0.99 * prob + 0.01 / k) * (np.clip(n / 4.0, 0.0, 2.0) * np.where(sure, 1.0, 0.25))[:, None]
    size, first = np.array([len(u) for u in units]), evidence.argmax(axis=1)
    hi = np.array(ends)
    lo = np.concatenate([[0], hi[:-1]])
    full = np.flatnonzero(hi > lo)
    total = np.add.reduceat(evidence, lo[full]).argmax(axis=1)
    words = np.add.reduceat(n, lo[full])
    mean = np.add.reduceat(prob * n[:, None], lo[full]) / np.maximum(words, 1)[:, None]
    chars = np.add.reduceat(size, lo[full])
    same = np.logical_and.reduceat(first == np.repeat(total, hi[full] - lo[full]), lo[full])
    threshold = scorer.model.threshold
    for j, i in enumerate(full.tolist()):
        if not words[j]:
            continue
        a, z, state = lo[i], hi[i], total[j]
        if same[j] or (path := _viterbi(evidence[a:z])) == [state] * (z - a):
            if mean[j, state] >= threshold or (prob[a:z, state] * sure[a:z]).max() >= threshold:
                out[i] = [(langs[state], int(chars[j]), float(mean[j, state]))]
            continue
        out[i] = _joined(path, n[a:z], size[a:z], prob[a:z], langs)
    return out


def _joined(path: list[int], n: np.ndarray, size: np.ndarray, prob: np.ndarray, langs: tuple[str, ...]) -> list[tuple[str, int, float]]:
    """Runs of one state as segments; runs of few words or little confidence take the language of the longer neighbour."""
    path = list(path)
    while True:
        cuts = [0] + [q for q in range(1, len(path)) if path[q] != path[q - 1]] + [len(path)]
        runs = list(zip(cuts, cuts[1:]))
        score = [(float((prob[c:d, path[c]] * n[c:d]).sum() / max(n[c:d].sum(), 1)), int(n[c:d].sum())) for c, d in runs]
        weak = [r for r, (conf, words) in enumerate(score) if words < LEAST_WORDS or conf < LEAST_SURE]
        if len(runs) == 1 or not weak:
            return [(langs[path[c]], int(size[c:d].sum()), conf) for (c, d), (conf, _) in zip(runs, score)]
        r = min(weak, key=lambda r: score[r][1])
        sides = [x for x in (r - 1, r + 1) if 0 <= x < len(runs)]
        to = path[runs[max(sides, key=lambda x: score[x][1])][0]]
        path[runs[r][0] : runs[r][1]] = [to] * (runs[r][1] - runs[r][0])


def _viterbi(ev: np.ndarray) -> list[int]:
    best, back = ev[0].copy(), []
    for row in ev[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


_SEGMENTS = "array<struct<lang:string,n_chars:int,confidence:double>>"


def _latest(found: DataFrame) -> DataFrame:
    """One row a record of record_id, loaded, segs: the latest loaded, then the greatest."""
    return found.groupBy("record_id").agg(F.max(F.struct("loaded", "stored", "segs")).alias("m")).select("record_id", "m.stored", F.posexplode("m.segs").alias("segment_no", "s")).select("record_id", "stored", "segment_no", "s.*")


def _segmented(rows: DataFrame, model: Model, key: str, text: str, lang: str, min_chars: int, every: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    trimmed = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    loaded = F.col("ingested_at") if "ingested_at" in rows.columns else F.lit(None).cast("timestamp")
    picked = rows.filter(clean_role(F.col("role")).isin("user", "assistant") & (F.length(trimmed) >= min_chars) & F.col(key).isNotNull())
    picked = picked.select(F.col(key).alias("record_id"), loaded.alias("loaded"), F.col(text).alias("text"), label(F.col(lang)).alias("stored"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            segs = segments(list(pdf["text"]), scorer)
            hit = [bool(s) and (every or len(s) > 1 or s[0][0] != lab) for s, lab in zip(segs, pdf["stored"])]
            if any(hit):
                kept = [[dict(zip(("lang", "n_chars", "confidence"), x)) for x in s] for s, h in zip(segs, hit) if h]
                yield pdf.loc[hit, ["record_id", "loaded", "stored"]].assign(segs=kept)

    return _latest(spread(picked).mapInPandas(run, f"record_id string, loaded timestamp, stored string, segs {_SEGMENTS}"))


def message_segments(rows: DataFrame, model: Model, key: str = "message_id", text: str = "text", lang: str = "lang", min_chars: int = 20) -> DataFrame:
    """record_id, stored, segment_no, lang, n_chars, confidence of every segment of the user and assistant messages of at least ``min_chars``."""
    return _segmented(rows, model, key, text, lang, min_chars, True)


def mislabelled_messages(rows: DataFrame, model: Model, key: str = "message_id", text: str = "text", lang: str = "lang", min_chars: int = 20) -> DataFrame:
    """record_id, stored, segment_no, lang, n_chars, confidence where a message mixes languages or its label is missing or wrong."""
    return _segmented(rows, model, key, text, lang, min_chars, False)


def chat_languages(parts: DataFrame, model: Model) -> DataFrame:
    """record_id, at, lang, n_chars over the segments of texts; ``parts``: record_id, at, text. Sums by batch first, so long chats are split."""
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            total: dict[tuple, int] = {}
            for key, at, segs in zip(pdf["record_id"], pdf["at"], segments(list(pdf["text"]), scorer)):
                for la, size, _ in segs:
                    total[key, at, la] = total.get((key, at, la), 0) + size
            if total:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["record_id", "at", "lang", "n_chars"])

    return parts.mapInPandas(run, "record_id string, at string, lang string, n_chars long")


def mislabelled_chats(raw: DataFrame, model: Model) -> DataFrame:
    """record_id, lang, confidence of fetched chats whose label is missing or isn't the language of most of their text.

    The label is that of the latest successful fetch; confidence is the share of the text in that language.
    """
    at = F.coalesce(F.col("fetched_at").cast("string"), F.lit(""))
    good = raw.filter("fetch_success and share_id is not null").select(F.col("share_id").alias("record_id"), "fetched_at", at.alias("at"), label(F.col("conversation_language")).alias("stored"), "messages")
    labels = good.groupBy("record_id").agg(F.max(F.struct("fetched_at", "at", "stored")).alias("m")).select("record_id", "m.at", "m.stored")
    said = good.select("record_id", "at", F.explode("messages").alias("m")).filter(clean_role(F.col("m.role")).isin("user", "assistant") & F.col("m.text").isNotNull())
    sizes = chat_languages(spread(said.select("record_id", "at", F.col("m.text").alias("text"))), model)
    total = sizes.groupBy("record_id", "at", "lang").agg(F.sum("n_chars").alias("n"))
    top = total.groupBy("record_id", "at").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), (F.max("n") / F.sum("n")).alias("confidence"))
    judged = top.join(labels, ["record_id", "at"])
    return judged.filter(~F.col("stored").eqNullSafe(F.col("lang"))).select("record_id", "lang", "confidence")
