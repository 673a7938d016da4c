"""Personal data in free text: found, counted by kind and replaced by typed placeholders.

The corpus decides how strongly a term tells of a person. Names have no form. A first pass counts for every term how often it
stands where a person is revealed by structure (the local part of an e-mail address, a contact line, a title or "my name is") and
how often it occurs at all; the log-ratio of the two against the corpus average says how many bits the term discloses, and
terms above ``BITS`` are disclosing. Two more passes learn the contexts: two words after which hardly a doubt is left that a pair of
disclosing terms follows (``CONTEXT_DOUBT`` bits) reveal a person too, and the pairs that follow them are counted in. A
disclosing given and family name together are a mention, in any case, order or handle.

E-mail addresses, telephone numbers, numbers a state gives out and street addresses have forms; a form makes a candidate. Forms
that nothing else shares stand for themselves. A bare run of ten digits is a telephone number only after terms that the corpus
shows before telephone numbers hardly more rarely than before numbers on the whole, again a log-ratio of counts.

Disclosing terms are kept as bit sets of ``SLOTS`` hash slots, so what reaches the workers has a fixed size however large
the corpus is.

Defined results: null and empty texts hold nothing; texts are read whole; a kind found several times in a record counts once;
repeat rows count once; records without id are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.session import checkpoint, spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: Bits a term must tell about a person, and how often it must have been seen to tell it.
BITS, LEAST_SEEN = 4.5, 2
#: Bits of doubt a context may leave whether a pair of disclosing terms follows, and how often it must have followed.
CONTEXT_DOUBT, CONTEXT_SEEN = 1.5, 3
#: Bits by which a term may stand more rarely before telephone numbers than before numbers on the whole.
PHONE_DOUBT = 2.0
SLOTS = 1 << 22
#: Counts a worker gathers before it hands them on.
FLUSH = 400_000

_EMAIL = re.compile(
    r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"
    r"|[\w.+%-]+ ?(?:\[at\]|\(at\)|\{at\}|<at>) ?[\w-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?|\.)[\w-]+)+"
    r"|[\w.+%-]+ at [\w-]+(?: dot [\w-]+)+",
    re.I,
)
_ID_CUE = r"(?:passport|passeport|pasaporte|reisepass|licen[cs]e|führerschein|id card|identity (?:card|number)|personalausweis|ausweis|social security|\bssn|national insurance|\bdni|\bnie|\bnif|steuer-?id|tax id|\bcpf|codice fiscale|\bbsn)"
_ID = re.compile(
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
    r"|(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"
    r"|(?<![\w-])\d{8}-[A-Z](?!\w)"
    r"|(?<!\w)[A-Z]{5}\d{6}[A-Z]{1,2}\w{2,3}(?!\w)"
    r"|(?<!\w)[A-Z]\d{3}[A-Z]\d{3}[A-Z]\d(?!\w)"
)
_ID_AFTER = re.compile(rf"(?i:{_ID_CUE})(?:[’']?s)?(?i: ?(?:number|no\.?|nr\.?|nummer|n[º°]\.?|card|is|:|#|numéro|número))*[ :#]*((?=(?:[ -]?[A-Z0-9]){{6,}})[A-Z]{{0,5}}\d(?:[ -]?[A-Z0-9])*[A-Z0-9])(?!\w)")
_PHONE = re.compile(
    r"(?<![A-Za-z0-9.])(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\w|\.\d)"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)"
    r"|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-]|\.\d)"
    r"|(?<![A-Za-z0-9.-])07\d{3} ?\d{6}(?![\d-])"
    r"|(?i:\b(?:tel|phone|mobile|whatsapp|fax|telefon|téléphone|teléfono|handy)\b)[^\w\n+(]{0,4}\d(?:[ ./-]?\d){6,12}(?![\w-])"
)
#: Ten digits that may be a telephone number, and a number with the word before it.
_BARE = re.compile(r"(?<![A-Za-z0-9.-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)")
_NUMBER = re.compile(r"([^\W\d_]+)[^\w\n(+]{0,5}([(+]?\d(?:[ .()-]{0,2}\d){5,})")
_CITY = r"(?:,? (?:Apt|Flat|Unit|Suite)\.? \w+| \d{1,2}º \w|, \d{1,2}º \w|, (?:\d{4,5} )?[A-ZÀ-Ý][\w’'-]+(?: [A-ZÀ-Ý][\w’'-]+)?)"
_ADDRESS = re.compile(
    r"(?:\b(?:Flat|Apt|Unit|Suite)\.? \w+, )?(?<![\w.,])\d{1,5}[A-Za-z]? (?:[A-Z][\w’'-]+ ){1,4}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Close|Court|Boulevard|Blvd|Way|Place|Terrace|Square|Crescent|Row|Gardens|Mews)\b\.?"
    rf"(?:{_CITY})*"
    rf"|\b[A-ZÄÖÜ][\wäöüß-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|straat|laan|gracht) \d{{1,4}}[a-z]?\b(?:{_CITY})*"
    rf"|(?<!\w)\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours) (?:(?:de la|des|de|du) |d[’'])?[A-ZÀ-Ý][\w’'-]+(?: [A-ZÀ-Ý][\w’'-]+)*(?:{_CITY})*"
    rf"|\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua|Avenida) (?:(?:de los|de las|de la|del|de|di|da|do|dos) )?[A-ZÀ-Ý][\w’'-]+(?: [A-ZÀ-Ý][\w’'-]+)*,? \d{{1,4}}\b(?:{_CITY})*"
    rf"|\b(?i:P\.? ?O\.? ?Box|Postfach|Postbus|Boîte postale|Apartado(?: de correos)?|Casella postale) \d+(?:{_CITY})*"
)
_DIGIT = re.compile(r"\d")
#: At least five digits close together.
_DIGITS = re.compile(r"\d(?:[^\d\n]{0,3}\d){4}")
#: Words that only addresses need (fixed values), and endings of street names.
_STREETS = frozenset("street st road rd avenue ave lane ln drive close court boulevard blvd way place terrace square crescent row gardens mews rue allée chemin impasse quai cours calle avenida avda plaza paseo camino via viale piazza rua box postfach postbus postale apartado".split())
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "straat", "laan", "gracht")
_AT_SIGNS = ("@", "(at)", "[at]", "{at}", "<at>")
#: Letters of one case pattern; handles are split at capitals, digits and signs.
_TERM = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+")
#: General phrases before a person's name, by a word of theirs (fixed values); all others are learnt.
CUES = {"name": ("name is ", "name: ", 'name": "'), "dr": ("dr. ",), "mr": ("mr. ",), "mrs": ("mrs. ",), "ms": ("ms. ",), "prof": ("prof. ",), "heiße": ("heiße ",), "appelle": ("m’appelle ", "m'appelle "), "llamo": ("me llamo ",), "chiamo": ("mi chiamo ",), "heet": ("ik heet ",)}
_PAIR = re.compile(r"(?:(?:dr|mr|mrs|ms|prof)\. )?([^\W\d_]{2,})(?: [^\W\d_]\.)?(,? )([^\W\d_]{2,})(?:-[^\W\d_]{2,})?", re.I)
_RECORD = re.compile(r"(?m)^([^\W\d_]{2,}) ([^\W\d_]{2,}) ?[|;,] ?(?=[<+(\d]|\S+@)")
#: Two words and, after a space or a sign, two terms that may be a name.
_BEFORE = re.compile(r"(?=(?<!\w)([^\W\d_]+)[^\w\n]{1,3}([^\W\d_]+)[^\w]{1,3}([^\W\d_]{2,})(?: [^\W\d_]\.)?(,? )([^\W\d_]{2,})(?!\w))")
_LOCAL = re.compile(r"\b([^\W\d_]{3,})[.-]([^\W\d_]{3,})(?=@| ?\[at\]| ?\(at\))")


class _Tokens(dict):
    """Raw token between white space -> bits of what it may be part of; remembers what it looked up."""

    GIVEN, FAMILY, STREET, AT, CUE, RECORD, DIGIT = 1, 2, 4, 8, 16, 32, 64

    def __init__(self, lexicon: dict[str, int] | None = None) -> None:
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        low = token.lower()
        words = _WORDS.findall(low)
        out = 0
        for w in words:
            if w in _STREETS or w.endswith(_STREET_ENDS):
                out |= self.STREET
            if w in CUES:
                out |= self.CUE
        if any(a in low for a in _AT_SIGNS) or low == "dot":
            out |= self.AT
        if "|" in low or ";" in low:
            out |= self.RECORD
        if _DIGIT.search(low):
            out |= self.DIGIT
        if self.lexicon is not None:
            for w in {*words, *(t.lower() for t in _TERM.findall(token))}:
                out |= self.lexicon[w]
        if len(self) > 300_000:
            self.clear()
        self[token] = out
        return out

    def bits(self, tokens: list[str]) -> int:
        out = 0
        for b in set(map(self.__getitem__, tokens)):
            out |= b
        return out


def _revealed(text: str, bits: int) -> Iterator[tuple[str, str]]:
    """(given, family) pairs where the context reveals a person."""
    low = text.lower()
    if bits & _Tokens.CUE:
        for word in CUES.keys() & set(_WORDS.findall(low)):
            for cue in CUES[word]:
                at = low.find(cue)
                while at >= 0:
                    m = _PAIR.match(low, at + len(cue))
                    if m:
                        yield (m[3], m[1]) if m[2] == ", " else (m[1], m[3])
                    at = low.find(cue, at + 1)
    if bits & (_Tokens.AT | _Tokens.RECORD):
        for m in _RECORD.finditer(low):
            yield m[1], m[2]
        for m in _LOCAL.finditer(low):
            yield m[1], m[2]


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) & (SLOTS - 1)


def _numbers(text: str) -> Iterator[tuple[str, bool]]:
    """(word before, whether a telephone number by form) of every longer number."""
    for m in _NUMBER.finditer(text):
        yield m[1].lower(), bool(_PHONE.search(m[2]))


_COUNTS = ("n", "given", "family", "number", "phone")


def _term_counts(texts: DataFrame, column: str) -> DataFrame:
    """term and how often: at all, as a given and a family name by structure, before a number, before a telephone number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, given, family, number, phone, tokens = Counter(), Counter(), Counter(), Counter(), Counter(), _Tokens()

        def rows() -> pd.DataFrame:
            every: Counter = Counter()
            for token, n in raw.items():
                for w in _WORDS.findall(token.lower()):
                    every[w] += n
            keys = list(every.keys() | number.keys())
            out = pd.DataFrame({"term": keys, **{name: [c[k] for k in keys] for name, c in zip(_COUNTS, (every, given, family, number, phone))}})
            for c in (raw, given, family, number, phone):
                c.clear()
            return out

        for pdf in batches:
            for t in pdf[column]:
                words = t.split()
                raw.update(words)
                bits = tokens.bits(words)
                if bits & (tokens.CUE | tokens.AT | tokens.RECORD):
                    for g, f in _revealed(t, bits):
                        given[g] += 1
                        family[f] += 1
                if bits & tokens.DIGIT and _DIGITS.search(t):
                    for w, is_phone in _numbers(t):
                        number[w] += 1
                        phone[w] += is_phone
            if len(raw) > FLUSH:
                yield rows()
        if raw:
            yield rows()

    counts = texts.select(column).filter(F.col(column).isNotNull()).mapInPandas(count, "term string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return checkpoint(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in _COUNTS]))  # used several times


def _ratio(part: str, whole: str, base: float) -> Column:
    """Bits that ``part`` of ``whole`` tells against the average."""
    return F.log2(F.col(part) / F.col(whole) / F.lit(base))


def _sets(flagged: DataFrame, key: str, flags: tuple[str, ...]) -> list[np.ndarray]:
    """Bit sets of the hash slots of ``key`` where a flag holds; at most ``SLOTS`` rows reach the driver."""
    slot = (F.crc32(F.encode(key, "UTF-8")) % SLOTS).cast("int")
    slots = flagged.filter(" or ".join(flags)).groupBy(slot.alias("slot")).agg(*[F.max(c).alias(c) for c in flags]).toPandas()
    out = []
    for c in flags:
        held = np.zeros(SLOTS, bool)
        held[slots.loc[slots[c].astype(bool), "slot"].to_numpy(dtype=np.int64)] = True
        out.append(np.packbits(held))
    return out


def _told(totals: DataFrame, base: float) -> list[np.ndarray]:
    seen = totals.filter((F.col("given") + F.col("family") >= LEAST_SEEN) & (F.length("term") >= 2) & (F.col("n") > 0))
    flags = seen.select("term", *[((F.col(c) > 0) & (_ratio(c, "n", base) >= BITS)).alias(f) for c, f in (("given", "g"), ("family", "f"))])
    return _sets(flags, "term", ("g", "f"))


def _split(m: re.Match) -> tuple[str, str, str]:
    """(context, given, family) of a match of ``_BEFORE``; the pair may be turned round by a comma."""
    return f"{m[1]} {m[2]}", *((m[5], m[3]) if m[4] == ", " else (m[3], m[5]))


def _before(text: str) -> Iterator[tuple[str, str, str]]:
    """(context, given, family) of the pairs of terms after two words."""
    return map(_split, _BEFORE.finditer(text.lower()))


def _contexts(texts: DataFrame, column: str, given: np.ndarray, family: np.ndarray) -> DataFrame:
    """context, hits: how often two words stand before a disclosing pair, of those that may still be learnt.

    The texts read here already count many pairs after a context; the whole corpus can only add to them, so a context that leaves
    too much doubt by these alone is never learnt and need not be counted in every text.
    """
    shared = texts.sparkSession.sparkContext.broadcast((given, family))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, hits, seen = Finder(*shared.value), Counter(), Counter()
        of = finder.lexicon.__getitem__

        def rows() -> Iterator[pd.DataFrame]:
            if hits:
                yield pd.DataFrame({"context": list(hits), "hits": list(hits.values()), "seen": [seen[c] for c in hits]})
            hits.clear()
            seen.clear()

        for pdf in batches:
            for t in pdf[column]:
                if finder.tokens.bits(t.split()) & 3 == 3:
                    for c, g, f in _before(t):
                        seen[c] += 1
                        if of(g) & 1 and of(f) & 2:
                            hits[c] += 1
            if len(seen) > FLUSH:
                yield from rows()
        yield from rows()

    rows = texts.select(column).filter(F.col(column).isNotNull()).mapInPandas(count, "context string, hits long, seen long")
    sums = rows.groupBy("context").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
    return sums.filter((F.col("hits") >= CONTEXT_SEEN) & (_ratio("hits", "seen", 1.0) >= -CONTEXT_DOUBT)).drop("seen")


def _after(texts: DataFrame, column: str, contexts: DataFrame) -> DataFrame:
    """context, given, family, n of every pair after one of the contexts; a row without pair counts a context without one."""
    word, yes = F.split("context", " "), F.lit(True)
    held = [_sets(contexts.select(c.alias("t"), yes.alias("c")), "t", ("c",))[0] for c in (word[0], word[1], F.col("context"))]
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, pairs = _Places(*shared.value), Counter()
        for pdf in batches:
            for t in pdf[column]:
                pairs.update(places.after(t))
            if len(pairs) > FLUSH:
                yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["context", "given", "family", "n"])
                pairs.clear()
        if pairs:
            yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["context", "given", "family", "n"])

    rows = texts.select(column).filter(F.col(column).isNotNull()).mapInPandas(count, "context string, given string, family string, n long")
    return rows.groupBy("context", "given", "family").agg(F.sum("n").alias("n"))


def disclosing(texts: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit sets of the terms that tell of a given name, of a family name and of a telephone number, from counts over the whole corpus."""
    totals = _term_counts(texts, column)
    sums = totals.agg(*[F.sum(c).alias(c) for c in _COUNTS]).first()
    none = np.zeros(SLOTS // 8, np.uint8)
    (phone,) = _sets(totals.filter("phone > 0").select("term", (_ratio("phone", "number", sums["phone"] / sums["number"]) >= -PHONE_DOUBT).alias("p")), "term", ("p",)) if sums["phone"] else (none,)
    if not sums["n"] or not sums["given"]:
        return none, none, phone
    base = sums["given"] / sums["n"]
    first = _told(totals, base)
    after = checkpoint(_after(texts, column, contexts := checkpoint(_contexts(texts, column, *first))))
    learnt = after.groupBy("context").agg(F.sum("n").alias("n")).join(contexts, "context").filter(_ratio("hits", "n", 1.0) >= -CONTEXT_DOUBT).select("context")
    pairs = after.join(learnt, "context", "left_semi")
    side = lambda c: pairs.select(F.col(c).alias("term"), *[(F.col("n") if c == o else F.lit(0)).alias(o) for o in ("given", "family")])
    more = side("given").unionByName(side("family")).groupBy("term").agg(F.sum("given").alias("more_given"), F.sum("family").alias("more_family"))
    both = totals.join(more, "term", "left").select("term", "n", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("given", "family")])
    return *_told(both, base), phone


class _Lexicon(dict):
    """Lower-case term -> 1 given, 2 family, 3 either, 0 neither; remembers what it looked up."""

    def __init__(self, given: np.ndarray, family: np.ndarray) -> None:
        self.given, self.family = given, family

    def __missing__(self, term: str) -> int:
        s = _slot(term)
        byte, bit = s >> 3, 0x80 >> (s & 7)
        out = bool(self.given[byte] & bit) + 2 * bool(self.family[byte] & bit)
        if len(self) > 200_000:
            self.clear()
        self[term] = out
        return out


class _Places(dict):
    """Raw token -> bits: 1 it ends in the first word of a context, 2 it starts with a second word, 4 it holds a first and a second, 8 it is without words."""

    #: A first word and a second after it, at most a token of signs between them.
    NEAR = re.compile(rb"[\1\3\5\7]\x08?[\2\3\6\7]|[\4-\7]")

    def __init__(self, first: np.ndarray, second: np.ndarray, whole: np.ndarray) -> None:
        self.first, self.second, self.whole = (_Lexicon(x, x) for x in (first, second, whole))

    def __missing__(self, token: str) -> int:
        words = _WORDS.findall(token.lower())
        out = (1 if self.first[words[-1]] else 0) | (2 if self.second[words[0]] else 0) | (4 if any(self.first[w] and self.second[v] for w, v in zip(words, words[1:])) else 0) if words else 8
        if len(self) > 300_000:
            self.clear()
        self[token] = out
        return out

    def after(self, text: str) -> Iterator[tuple[str, str, str]]:
        """What ``_before`` gives for the contexts held, looked for only where their first words stand."""
        if not self.NEAR.search(bytes(map(self.__getitem__, text.split()))):
            return
        low = text.lower()
        words = list(_WORDS.finditer(low))
        for w, v in zip(words, words[1:]):
            if self.first[w[0]] and self.second[v[0]] and self.whole[f"{w[0]} {v[0]}"] and (m := _BEFORE.match(low, w.start())):
                yield _split(m)


class Finder:
    def __init__(self, given: np.ndarray, family: np.ndarray, phone: np.ndarray | None = None) -> None:
        self.lexicon = _Lexicon(given, family)
        self.before_phone = None if phone is None else _Lexicon(phone, phone)
        self.tokens = _Tokens(self.lexicon)

    def _bare(self, text: str) -> list[tuple[int, int]]:
        """Runs of ten digits after nothing, a disclosing name or a term that stands before telephone numbers."""
        out = []
        for m in _BARE.finditer(text):
            words = _WORDS.findall(text[max(0, m.start() - 60) : m.start()].rpartition("\n")[2].lower())
            if not words or self.lexicon[words[-1]] or (self.before_phone is not None and self.before_phone[words[-1]]):
                out.append(m.span())
        return out

    def names(self, text: str) -> list[tuple[int, int]]:
        of, out = self.lexicon.__getitem__, []
        terms = [(m.start(), m.end(), of(m.group().lower())) for m in _TERM.finditer(text)]
        i = 0
        while i < len(terms) - 1:
            s, e, k = terms[i]
            if not k:
                i += 1
                continue
            j = i + 1
            gap = text[e : terms[j][0]]
            if k & 1 and gap == " " and terms[j][1] - terms[j][0] == 1 and j + 1 < len(terms) and text[terms[j][1] : terms[j + 1][0]] == ". ":
                j, gap = j + 1, " "  # a middle initial
            other = terms[j][2]
            forward = k & 1 and other & 2 and gap in (" ", "_", "-", ".", "")
            backward = k & 2 and other & 1 and gap in (", ", "_", "-", ".", "")
            if forward or backward:
                while j + 1 < len(terms) and terms[j + 1][2] & 2 and text[terms[j][1] : terms[j + 1][0]] == "-":
                    j += 1
                out.append((s, terms[j][1]))
                i = j + 1
            else:
                i += 1
        return out

    def mentions(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every mention, in order, without overlaps."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = []
        rest = text

        def take(spans: list[tuple[int, int]], kind: str) -> None:
            nonlocal rest
            for s, e in spans:
                found.append((s, e, kind))
                rest = rest[:s] + "\x00" * (e - s) + rest[e:]

        bits = self.tokens.bits(text.split())
        if bits & _Tokens.AT:
            take([m.span() for m in _EMAIL.finditer(rest)], "email")
        if bits & _Tokens.DIGIT:
            if _DIGITS.search(rest):
                take([m.span() for m in _ID.finditer(rest)], "id_number")
                take([m.span(1) for m in _ID_AFTER.finditer(rest) if sum(c.isdigit() for c in m[1]) >= 5], "id_number")
                take([m.span() for m in _PHONE.finditer(rest)], "phone")
                take(self._bare(rest), "phone")
            if bits & _Tokens.STREET:
                take([m.span() for m in _ADDRESS.finditer(rest)], "address")
        if bits & 3 == 3:
            take(self.names(rest), "name")
        return sorted(found)

    def sanitise(self, text: str | None) -> str | None:
        """The text with every mention replaced by its placeholder."""
        if not text:
            return text
        out, last = [], 0
        for s, e, kind in self.mentions(text):
            out += [text[last:s], f"[{kind}]"]
            last = e
        return "".join(out) + text[last:]


def fields(conversations: DataFrame, comments: DataFrame) -> DataFrame:
    """src_table, field, record_id, text of the three fields; each table is read once."""
    one = conversations.select(F.lit("conversations").alias("src_table"), F.lit("text").alias("field"), F.col("message_id").alias("record_id"), F.col("text").alias("text"))
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("body", "author")])
    two = comments.select(F.lit("reddit_comments").alias("src_table"), F.col("id").alias("record_id"), F.inline(pair)).select("src_table", "field", "record_id", "text")
    return one.unionByName(two).filter("record_id is not null and text is not null and text != ''")


def _shared(texts: DataFrame) -> Broadcast:
    return texts.sparkSession.sparkContext.broadcast(disclosing(texts, "text"))


def found(texts: DataFrame) -> DataFrame:
    """src_table, field, record_id, pii_type: one row per kind of personal data in a record's field."""
    shared = _shared(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, known = Finder(*shared.value), {}
        for pdf in batches:
            out = []
            for src, field, key, text in zip(pdf["src_table"], pdf["field"], pdf["record_id"], pdf["text"]):
                if field == "author":
                    kinds = known.get(text)
                    if kinds is None:
                        if len(known) > 100_000:
                            known.clear()
                        kinds = known[text] = {k for *_, k in finder.mentions(text)}
                else:
                    kinds = {k for *_, k in finder.mentions(text)}
                out += [(src, field, key, k) for k in kinds]
            if out:
                yield pd.DataFrame(out, columns=["src_table", "field", "record_id", "pii_type"])

    return spread(texts).mapInPandas(run, "src_table string, field string, record_id string, pii_type string").distinct()


def sanitised(texts: DataFrame) -> DataFrame:
    """src_table, field, record_id, text: every text with placeholders, repeat rows once."""
    shared = _shared(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for pdf in batches:
            yield pdf.assign(text=[finder.sanitise(t) for t in pdf["text"]])

    return texts.mapInPandas(run, "src_table string, field string, record_id string, text string").dropDuplicates(["src_table", "field", "record_id"])
