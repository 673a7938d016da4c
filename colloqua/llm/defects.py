"""Defective prompt and response pairs, each with one defect type.

In this order, the first that holds: ``empty_answer`` (null, blank, no letter or digit, or a stand-in for nothing);
``copied_question`` (compressed with its question as zstandard dictionary next to nothing is left of what the answer takes
alone, and the words confirm it); ``refusal`` (refusal phrases in eight languages and hardly a word besides);
``wrong_language`` (language model of ``langid``; not if the question names the answer's language); ``truncated_answer`` (open
code fence or list marker, or an ending in whose context texts of this corpus go on rather than end).

A question of fewer than ``TELLING`` words (thanks, go on) has no language of its own: the language of most answers to the same
words over the whole corpus counts as its language where that majority is clear, else no answer to it is wrong.

The terminal-context model counts, over all answers, how often the last word, and the words before a free last one, two or three
words, stand at the end of a sentence or line. The odds of the context and of the word against the average give the probability
of an end. Contexts are told apart by 64-bit hashes and counted exactly, but only those that some open ending asks for: a bitmap
of fixed size lets the others out before they are shuffled, and the counts are joined. Only ends inside a text are counted,
because the last one may itself be cut.

Defined results: pairs without positive turn or without conv_id are left out; repeat rows count once; a null question makes
no copy and no wrong language; texts are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloqua.llm.langid import Model, Scorer, segments
from colloqua.session import checkpoint, spread

TYPES = ("empty_answer", "copied_question", "refusal", "wrong_language", "truncated_answer")
#: Bits of the filter; if many contexts share a bit, more rows are shuffled and no count changes.
FILTER_BITS = 1 << 27
#: Share of its compressed size that an answer may keep with its question as dictionary, bytes of a lead-in that do not count,
#: share of word triples known from the question, and words around them, at which an answer is a copy.
COPY_LEFT, LEAD_IN, COPY_KNOWN, COPY_AROUND = 0.4, 12, 0.8, 3
#: Probability of an end below which an answer without closing sign is cut: items of lists without such signs, other lines.
END_LIST, END_LINE = 0.1, 0.6
#: Words from which a question tells its language, confidence it must have, and share of a clear majority of answers.
TELLING, SURE, MAJORITY = 4, 0.8, 0.8

_STAND_IN = re.compile(r"[\[(<{]*\s*(?:n/?a|null|none|nil|nan|undefined|empty|blank|tbd|todo|(?:no|missing|empty) (?:content|answer|response|text|output|data)|(?:content|answer|response) (?:missing|removed|deleted|unavailable))\s*[\])>}]*\.?", re.I)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
_MARKER = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s*")
#: Cells of a data line.
_DATA = re.compile(r"\||;\S")
#: Web and mail addresses, long numbers and codes of capitals and digits.
_ADDRESS_END = re.compile(r"(?:@\S+|://\S+|\w\.\w+/\S+|\[dot\] ?\w+|\(at\)\S+|\b\d[\d .()-]{6,}|(?<![\w-])(?=[A-Z-]*\d)[A-Z\d-]{5,})$")
#: Phrases of refusals (fixed values), by language.
REFUSALS = (
    r"\b(?:i|we)(?:['’]m| am| are| must)?\b[^.!?\n]{0,30}\b(?:can(?:no|['’])?t|cannot|won['’]t|will not|unable|not able|not in a position|decline|refuse)\b",
    r"\bagainst (?:my|our) (?:guidelines|policy|policies|rules|principles)\b|\bas an? (?:ai|language model)\b|\b(?:is not|isn['’]t) something i\b|\bmy apologies\b|\bhave to (?:pass|refuse|decline)\b|\b(?:not|isn['’]t)\b[^.!?\n]{0,30}\bcomfortable\b|\bfor safety reasons\b",
    r"\b(?:modèle de langage|sprachmodell|modelo de (?:lenguaje|linguagem)|modello linguistico|taalmodel)\b|языков\w+ модел",
    r"\b(?:kann|darf|möchte|werde)\b[^.!?\n]{0,40}\bnicht\b|\btut mir leid\b|\bverstößt gegen\b|\bnicht in der lage\b|\blehne\b[^.!?\n]{0,30}\bab\b|\bmuss ich\b[^.!?\n]{0,30}\bablehnen\b",
    r"\bje (?:suis (?:vraiment )?désolée?|ne peux|ne suis pas en mesure|refuse|regrette)\b|\bdésolée?\b|\bdois refuser\b|\bm[’']est impossible\b|\b(?:contre (?:de )?|à l[’']encontre de )mes (?:règles|principes|consignes)\b",
    r"\blo siento\b|\bno puedo\b|\bno me es posible\b|\bno estoy en condiciones\b|\bva en contra de mis\b|\bdebo (?:negarme|rechazar)\b|\btengo que (?:negarme|rechazar)\b",
    r"\bnão (?:posso|consigo|me é possível)\b|\b(?:desculp[ea]|lamento|sinto muito)\b",
    r"\bmi dispiace\b|\bnon (?:posso|sono in grado|mi è possibile)\b",
    r"\bhet spijt me\b|\bik (?:kan|mag|wil)\b[^.!?\n]{0,40}\bniet\b|\bkan ik\b[^.!?\n]{0,40}\bniet\b|\bhelaas\b[^.!?\n]{0,40}\bniet\b",
    r"к сожалению|не могу|извините|прошу прощения|вынужден[аы]? отказ",
)
_REFUSAL = re.compile("|".join(REFUSALS), re.I)
#: Words an answer may hold beside its refusing sentences.
REFUSAL_REST = 16
#: Names of the languages in the languages (fixed values).
NAMES = {
    "en": "english englisch anglais inglés inglês inglese engels английск",
    "de": "german deutsch allemand alemán alemão tedesco duits немецк",
    "fr": "french französisch français francés francês francese frans французск",
    "es": "spanish spanisch espagnol español espanhol spagnolo spaans испанск castellano",
    "pt": "portuguese portugiesisch portugais portugués português portoghese portugees португальск",
    "it": "italian italienisch italien italiano italiaans итальянск",
    "nl": "dutch niederländisch holländisch néerlandais neerlandés holandés neerlandês holandês olandese nederlands голландск нидерландск",
    "ru": "russian russisch russe ruso russo russisch русск",
}
_NAMES = {k: re.compile("|".join(v.split()), re.I) for k, v in NAMES.items()}


def _is_blank(text: str) -> bool:
    return not any(unicodedata.category(c)[0] in "LNS" for c in text)


def is_empty(answer: str | None) -> bool:
    return answer is None or _is_blank(answer) or bool(_STAND_IN.fullmatch(answer.strip()))


def _plain(text: str) -> str:
    return " ".join(_WORD.findall(text.casefold()))


def _packed(data: bytes, known: bytes | None) -> int:
    """Bytes of zstandard blocks, with ``known`` as dictionary."""
    d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if known else None
    packer = zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(data)) - 9  # frame and block headers


def is_copy(question: str | None, answer: str) -> bool:
    if not question or _is_blank(question):
        return False
    q, a = _plain(question), _plain(answer)
    if not a or not q:
        return False
    data = a.encode()
    left = _packed(data, q.encode()) - LEAD_IN
    if left > COPY_LEFT * len(data) or left > COPY_LEFT * _packed(data, None):
        return False
    aw, qw = a.split(), q.split()
    n = min(3, len(aw))
    around = qw + qw[: n - 1]  # also where the question is given back twice
    have = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    mine = [tuple(aw[i : i + n]) in have for i in range(len(aw) - n + 1)]
    if True not in mine:
        return False
    lo, hi = mine.index(True), len(mine) - mine[::-1].index(True)
    return lo <= COPY_AROUND and len(mine) - hi <= COPY_AROUND and sum(mine[lo:hi]) >= COPY_KNOWN * (hi - lo)


def is_refusal(answer: str) -> bool:
    rest, refused = 0, False
    for line in answer.split("\n"):
        for s in _SENTENCE.split(line):
            if _REFUSAL.search(s):
                refused = True
            elif (rest := rest + len(_WORD.findall(s))) > REFUSAL_REST:
                return False
    return refused


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


#: Odd multipliers that tell the places of a context's words apart (fixed values).
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _keys(k: int, hashes: list[np.ndarray]) -> np.ndarray:
    """64-bit key of each context of kind ``k``; ``hashes``: the words' hashes, the last word first."""
    key = hashes[0] * _PLACES[0] + np.uint64(0xD6E8FEB86659FD93 * (k + 1) % (1 << 64))
    for h, m in zip(hashes[1:], _PLACES[1:]):
        key = key + h * m
    return (key ^ (key >> np.uint64(29))).view(np.int64)


#: Contexts of the model: how many of the last words stand free, and how many words before those are fixed. The first is the word itself.
CONTEXTS = ((0, 1), (1, 3), (2, 3), (3, 3))
#: Times a longer context must have been seen to count.
LEAST_CONTEXT = 5


def context_keys(text: str) -> list[int | None]:
    """Key of the context of each kind at the end of ``text``, None where it has too few words; empty without words."""
    w = _WORD.findall(text.lower()[-300:])
    h = [np.array([xxhash.xxh64_intdigest(x)], dtype=np.uint64) for x in w[-6:]]
    return [int(_keys(k, [h[len(h) - 1 - free - j] for j in range(fixed)])[0]) if len(w) >= free + fixed else None for k, (free, fixed) in enumerate(CONTEXTS)] if w else []


def _counted(texts: list[str], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Keys of the contexts inside ``texts``, their ends and occurrences, and both over all single words; ``bits``: keys to keep."""
    of, flat, sizes = _Hashes().__getitem__, [], []
    for text in texts:
        units = [u for line in text.split("\n") for u in _SENTENCE.split(line) if u and not u.isspace()]
        for unit in units[:-1]:
            words = _WORD.findall(unit.lower())
            flat.extend(map(of, words))
            sizes.append(len(words))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
    n = np.array(sizes, dtype=np.int64)
    h, end = np.array(flat, dtype=np.uint64), np.cumsum(n)
    place = np.arange(len(h)) - np.repeat(end - n, n)
    last = place == np.repeat(n, n) - 1
    keys, ends, base = [], [], (0, 0)
    for k, (free, fixed) in enumerate(CONTEXTS):
        at = np.flatnonzero(place >= max(1, free + fixed - 1))
        key, is_end = _keys(k, [h[at - free - j] for j in range(fixed)]), last[at]
        if k == 0:
            base = int(is_end.sum()), len(at)
        if bits is not None:
            slot = key & np.int64(FILTER_BITS - 1)
            kept = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            key, is_end = key[kept], is_end[kept]
        keys.append(key), ends.append(is_end)
    each, which, total = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return each, np.bincount(which, np.concatenate(ends), len(each)).astype(np.int64), total, *base


class Endings:
    """How often a context of last words ends a sentence or line.

    Beside the last word there are contexts whose last one to three words are free, so that "half is the <any> <any>" is known to
    end a sentence whatever the two words are. Held whole, so for a few texts only.
    """

    def __init__(self) -> None:
        self.counts: dict[int, tuple[int, int]] = {}
        self.base_ends = self.base_all = 0

    def add(self, texts: list[str]) -> None:
        keys, ends, n, base_ends, base_all = _counted(texts)
        for key, e, m in zip(keys.tolist(), ends.tolist(), n.tolist()):
            a, b = self.counts.get(key, (0, 0))
            self.counts[key] = a + e, b + m
        self.base_ends, self.base_all = self.base_ends + base_ends, self.base_all + base_all

    def probability(self, text: str) -> float:
        keys = context_keys(text)
        return _probability([None if k is None else self.counts.get(k, (0, 0)) for k in keys], self.base_ends / max(1, self.base_all)) if keys else 1.0

    def cut(self, last: str, limit: float) -> bool:
        return self.probability(last) < limit


class _Asked:
    """Stands for the model until its counts are known: keeps what was asked last."""

    def __init__(self) -> None:
        self.last: tuple[str, float] | None = None

    def cut(self, last: str, limit: float) -> bool:
        self.last = last, limit
        return False


#: Least and greatest probability that enters the odds.
_EDGE = 1e-4


def _odds(p: float) -> float:
    return np.log(max(p, _EDGE) / max(1 - p, _EDGE))


def _probability(counts: list[tuple[int, int] | None], base: float) -> float:
    """Probability of an end by ends and occurrences of each kind of context: the best of word and context together."""
    word = (counts[0][0] + base) / (counts[0][1] + 1)
    sums = [_odds((c[0] + base) / (c[1] + 1)) + _odds(word) - _odds(base) for c in counts[1:] if c is not None and c[1] >= LEAST_CONTEXT]
    return float(1 / (1 + np.exp(-max(sums)))) if sums else float(word)


def endings(texts: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """key, ends, n of the contexts in ``wanted`` (key) over all texts, some others, and a row without key for all words."""
    x = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = wanted.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # 4,096 rows of 4 KB at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(pdf[column])
            for lo in range(0, len(rows), 2000):
                keys, ends, n, base_ends, base_all = _counted(rows[lo : lo + 2000], shared.value)
                yield pd.DataFrame({"key": pd.array([*keys.tolist(), None], dtype="Int64"), "ends": [*ends.tolist(), base_ends], "n": [*n.tolist(), base_all]})

    rows = spread(texts.select(column).filter(F.col(column).isNotNull())).mapInPandas(count, "key long, ends long, n long")
    return rows.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def _limit(lines: list[str]) -> float:
    """The limit for the last line: that of lists where it belongs to one whose other items have no closing signs either."""
    others = [ln for ln in lines[:-1] if ln.strip() and not ln.strip().startswith("```")]
    items = [ln for ln in others if _MARKER.match(ln)]
    same = items if _MARKER.match(lines[-1]) else others
    if any(ln.rstrip()[-1].isalnum() for ln in same):
        return END_LIST
    return END_LIST if _MARKER.match(lines[-1]) and not items else END_LINE


def is_truncated(answer: str, model: Endings | _Asked) -> bool:
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    lines = text.split("\n")
    last = lines[-1]
    if _MARKER.fullmatch(last) or (last.strip() in ("-", "*", "+")):
        return True
    final = text[-1]
    if final in ".!?…`|]}\"'”’»)" or unicodedata.category(final)[0] == "S" or ord(final) in (0xFE0F, 0x200D):
        inner = text.rstrip("\"'”’»)")
        return bool(inner) and inner[-1] in ",(–—-"
    if final in ",;:(–—-/&«“‘„[{":
        return True
    if _DATA.search(last) or _ADDRESS_END.search(last):
        return False
    return model.cut(last, _limit(lines))


def asks_for(question: str, language: str) -> bool:
    return bool(_NAMES[language].search(question))


def defect(question: str | None, answer: str | None, model: Endings | _Asked, spoken: set[str], answered: str | None) -> str | None:
    """The defect type of a pair; ``spoken``: languages of the question, ``answered``: language of the answer."""
    if is_empty(answer):
        return "empty_answer"
    if is_copy(question, answer):
        return "copied_question"
    if is_refusal(answer):
        return "refusal"
    if spoken and answered and answered not in spoken and not asks_for(question or "", answered):
        return "wrong_language"
    return "truncated_answer" if is_truncated(answer, model) else None


def _short(question: str | None) -> str | None:
    """The words of a question too short to tell its language, None for others."""
    plain = _plain(question or "")
    return plain if 0 < len(plain.split()) < TELLING else None


def _spoken(question: str | None, segs: list[tuple[str, int, float]]) -> set[str]:
    """Languages of a question that tells them."""
    return set() if question is None or len(_WORD.findall(question)) < TELLING or (len(segs) == 1 and segs[0][2] < SURE) else {s[0] for s in segs}


def _against_majority(seen: DataFrame) -> DataFrame:
    """short, answered: languages that answers to these words have and that a clear majority of such answers has not."""
    n = seen.filter("short is not null and answered is not null").groupBy("short", "answered").agg(F.count("*").alias("n"))
    total = n.groupBy("short").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return n.join(total, "short").filter((F.col("most") >= MAJORITY * F.col("total")) & (F.col("n") < F.col("most"))).select("short", "answered")


def found(pairs: DataFrame, languages: Model) -> DataFrame:
    """conv_id, turn, defect_type of every defective user-to-assistant pair."""
    langs = pairs.sparkSession.sparkContext.broadcast(languages)
    picked = pairs.filter("turn > 0 and conv_id is not null").select("conv_id", F.col("turn").cast("int").alias("turn"), "user_text", "assistant_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(langs.value)
        for pdf in batches:
            qs, an = list(pdf["user_text"]), list(pdf["assistant_text"])
            spoken, answered = segments(qs, scorer), segments(an, scorer)
            out = []
            for conv, turn, q, a, sq, sa in zip(pdf["conv_id"], pdf["turn"], qs, an, spoken, answered):
                main = max(sa, key=lambda s: s[1], default=None)
                lang = main[0] if main and main[2] >= 0.9 and main[1] >= 20 else None
                kind, short = defect(q, a, asked := _Asked(), _spoken(q, sq), lang), _short(q)
                if kind and (kind != "truncated_answer" or not short):
                    out.append((conv, turn, kind, None, None, None, None))
                    continue
                keys = context_keys(asked.last[0]) if not kind and asked.last else None
                if kind or keys or short:
                    out.append((conv, turn, kind, short if lang else None, lang if not asks_for(q or "", lang or "en") else None, asked.last[1] if keys else None, keys or None))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "turn", "defect_type", "short", "answered", "limit", "keys"])

    seen = checkpoint(spread(picked).mapInPandas(run, "conv_id string, turn int, defect_type string, short string, answered string, limit double, keys array<long>"))
    foreign = seen.filter("short is not null").join(_against_majority(seen), ["short", "answered"], "left_semi").select("conv_id", "turn", F.lit("wrong_language").alias("defect_type"))
    unsure = seen.filter("keys is not null").select("conv_id", "turn", "limit", "keys")
    wanted = unsure.select(F.explode("keys").alias("key")).filter("key is not null")
    counts = checkpoint(endings(pairs, "assistant_text", wanted))
    total = counts.filter("key is null").first()
    base = min(max(total["ends"] / max(1, total["n"]) if total else 0.0, _EDGE), 1 - _EDGE)
    known = unsure.select("*", F.posexplode("keys").alias("k", "key")).join(counts, "key", "left")
    of = [F.max(F.when((F.col("k") == k) & F.col("key").isNotNull(), F.struct(F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("n", F.lit(0)).alias("n")))).alias(f"c{k}") for k in range(len(CONTEXTS))]
    share = [(F.col(f"c{k}.ends") + base) / (F.col(f"c{k}.n") + 1) for k in range(len(CONTEXTS))]
    odds = lambda p: F.log(F.greatest(p, F.lit(_EDGE)) / F.greatest(1 - p, F.lit(_EDGE)))
    best = F.greatest(*[F.when(F.col(f"c{k}.n") >= LEAST_CONTEXT, odds(share[k]) + odds(share[0]) - _odds(base)) for k in range(1, len(CONTEXTS))])
    p = F.when(best.isNotNull(), 1 / (1 + F.exp(-best))).otherwise(share[0])
    cut = known.groupBy("conv_id", "turn", "limit", "keys").agg(*of).filter(p < F.col("limit")).select("conv_id", "turn", F.lit("truncated_answer").alias("defect_type"))
    every = seen.filter("defect_type is not null").select("conv_id", "turn", "defect_type").unionByName(foreign).unionByName(cut)
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("defect_type"))
    return every.groupBy("conv_id", "turn").agg(F.min_by("defect_type", order).alias("defect_type"))
