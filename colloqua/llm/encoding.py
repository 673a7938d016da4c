"""Text that was decoded with the wrong character encoding: found by round trips and restored where possible.

A run of characters is put back to bytes under a candidate legacy encoding and those bytes are decoded strictly as UTF-8.
The candidate is taken when a garbling cost drops, and the step is repeated for nested layers. The cost counts characters
outside ASCII by how unusual they are, and adds to it for neighbours that do not occur in sound text (two scripts in one
word, a symbol between letters, an accented capital after a small letter). What was lost for good (replacement characters,
bytes that were stripped) is found by its traces and reported as not restorable.

Characters that a text only quotes as its topic (a short quoted string without any ASCII character) do not count.

Defined results: null, empty and ASCII texts are clean; texts are processed whole whatever their length; repeat rows of a
record count once; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that text is misread in, most usual first.
CANDIDATES = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1250", "iso8859-2", "cp437", "cp1254", "iso8859-15", "cp850", "koi8-r")
#: Misread as -> intended, for single-byte texts; whole words of letters outside ASCII are recoded.
SINGLE_BYTE = (("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("mac_roman", "cp1251"))
_PUNCT = set("‘’“”„«»–—…€£¡¿§·•™°×½¼¾µ©®’‚†")
_LETTERS = set("äöüßÄÖÜéèêëàâçîïôùûœæÉÈÊÀÂÇÎÏÔÙÛŒÆáíóúñÁÍÓÚÑãõÃÕåÅøØìòÌÒýÝðþÐÞÿăâșțąćęłńóśźżčďěňřšťůžŠŽČŁŚŻőűğışİŞĞ")


def _weight(c: str) -> float:
    n = ord(c)
    if n < 128:
        return 0.0
    if n < 160 or n == 0xFFFD:
        return 3.0
    if c in _PUNCT or c in _LETTERS or 0x410 <= n <= 0x44F or n in (0x401, 0x451):
        return 1.0
    if n == 0xA0 or 0x1F300 <= n <= 0x1FAFF or 0x2190 <= n <= 0x27BF or 0x2500 <= n <= 0x25FF or n in (0xFE0F, 0x200D):
        return 1.0
    if n <= 0xFF or 0x100 <= n <= 0x17F or 0x370 <= n <= 0x4FF or 0x2000 <= n <= 0x22FF:
        return 1.6
    if 0x3040 <= n <= 0xD7FF or 0x5D0 <= n <= 0x64A or 0x900 <= n <= 0xDFF:
        return 1.6
    return 4.0


_weigh = functools.lru_cache(maxsize=4096)(_weight)
_SYMBOLS = "¢£¤¥¦§¨©ª«¬®¯°±²³´¶¸¹º»¼½¾¿√∫≤≥∂∑∏π◊‚„†‡ˆ‰‹›˜Ã‚Ђђ"
_ODD = re.compile(
    "[A-Za-zÀ-ÖØ-öø-ſ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÖØ-öø-ſ]"
    f"|(?<=[^\\W\\d_])[{_SYMBOLS}](?=[^\\W\\d_])"
    "|(?<=[a-zà-öø-ÿ])[À-ÖØ-Þ]"
    "|(?<=[а-яё])[ЂЃЉЊЌЋЏЎЈҐЄЇ†‡А-ЯЁ]"
    "|(?<=[À-ÿ]{3})[À-ÿ]"
)


_HIGH = re.compile("[^\x00-\x7f]")


def cost(text: str) -> float:
    return sum(map(_weigh, _HIGH.findall(text))) + 2.0 * len(_ODD.findall(text))


def _charmap(name: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out  # bytes without a character pass as control characters, as lenient readers do


def _class(chars: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in chars.items() if lo <= b <= hi) + "]"


@functools.cache
def _rounds() -> tuple[tuple[re.Pattern, dict[int, int]], ...]:
    """For each candidate: the pattern of its UTF-8 runs and the table from characters to bytes (as latin-1)."""
    return tuple((re.compile(f"(?:{_sequence(name)})+"), {ord(c): b for c, b in _charmap(name).items()}) for name in CANDIDATES)


def _sequence(name: str) -> str:
    m = _charmap(name)
    tail = _class(m, 0x80, 0xBF)
    lead = "[" + _class(m, 0xC2, 0xC5)[1:-1] + _class(m, 0xCE, 0xD1)[1:-1] + "]"  # Latin, Greek and Cyrillic blocks
    return f"{lead}{tail}|{_class(m, 0xE1, 0xEF)}{tail}{{2}}|{_class(m, 0xF0, 0xF0)}{tail}{{3}}"


@functools.cache
def _any_run() -> re.Pattern:
    return re.compile("|".join(map(_sequence, CANDIDATES)))


@functools.cache
def _recodings() -> tuple[dict[int, str], ...]:
    out = []
    for read, meant in SINGLE_BYTE:
        pairs = {c: bytes([b]).decode(meant, "ignore") for c, b in _charmap(read).items()}
        out.append({ord(c): t for c, t in pairs.items() if t and (t.isalpha() or c.isalpha())})
    return tuple(out)


def _once(text: str, pattern: re.Pattern, table: dict[int, int]) -> str:
    def decode(m: re.Match) -> str:
        try:
            return m.group().translate(table).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()

    return pattern.sub(decode, text)


#: Words only of accented letters, or Cyrillic with capitals after small letters.
_STRANGE = re.compile("[À-ÿ]{4}|[а-яё][А-ЯЁ]{2}|[А-ЯЁ]?[а-яё][А-ЯЁ]\\b")


def restore(text: str) -> str:
    """The text after as many round trips as lower its cost."""
    now = -1.0
    while True:  # every round lowers the cost by more than half a point
        best, runs, strange = text, _any_run().search(text), _STRANGE.search(text)
        if not (runs or strange):
            break
        best_cost = now = cost(text) if now < 0 else now
        if runs:
            for pattern, table in _rounds():
                if (new := _once(text, pattern, table)) != text and (c := cost(new)) < best_cost - 0.5:
                    best, best_cost = new, c
                    if not (_ODD.search(new) or (_TRACE.search(new) and _LOST.search(new))):
                        break
        if strange and best is text:
            for table in _recodings():
                new = text.translate(table)
                if new != text and (c := cost(new)) < best_cost - 3:
                    best, best_cost = new, c
        if best is text:
            break
        text, now = best, best_cost
    return text


#: A short quoted string of non-ASCII characters only.
_TOPIC = re.compile("([`'\"“])[^\x00-\x7f\\s]{1,8}([`'\"”])")
#: Traces of what cannot be put back.
_LOST = re.compile(
    "�|[\x80-\x9f]"
    "|[a-z]â(?:s|re|ll|ve|d|m)\\b|nât\\b|(?<!\\S)â(?!\\S)|(?<![^\\W\\d_])â[a-zA-Z0-9]+[^â\\n]{0,60}?â(?![^\\W\\d_])|â[¦¬¢€]|â(?=[.,;:!?]?\\s)"
    "|(?<=[a-zß-ÿ])Ã|Ã(?=[\\sa-z\xa0­])|Â(?=[\\s.,;]|$)|(?<![^\\W\\d_])ð(?![^\\W\\d_])|(?<=[^\\W\\d_])[√¬](?=[^\\W\\d_])"
    "|[ÃÂ][\xa0-\xbf]|ï¿½|ï»¿|â€|[ÐÑ](?=[а-яё\\s.,])|(?<=[а-яё])[ÐÑ]"
)
_TRACE = re.compile("[âÃÂð√¬ÐÑï�\x80-\x9f]")
#: What Spark looks for before a text is sent to Python: any two neighbours outside ASCII, or one of the traces.
SUSPECT = "[^\\x00-\\x7F]{2}|[\\x{FFFD}\\x{80}-\\x{9F}âÃÂð√¬ÐÑ]"


def examine(text: str | None) -> tuple[bool, str | None]:
    """(affected, restored text or None where nothing can be restored)."""
    if not text or not _HIGH.search(text):
        return False, None
    bare = _TOPIC.sub("", text)
    if not _HIGH.search(bare):
        return False, None
    fixed = restore(bare)
    lost = bool(_TRACE.search(fixed) and _LOST.search(fixed))
    if fixed == bare:
        return lost, None
    if bare != text:  # what is quoted stays as it is
        kept: list[str] = []
        marked = _TOPIC.sub(lambda m: kept.append(m.group()) or "\x00", text)
        fixed = re.sub("\x00", lambda _: kept.pop(0), restore(marked))
    return True, None if lost else fixed


_MIXED = re.compile("[âÃÂÐÑðŃĂŢвГ√Р├Γ\x80-\x9f]|[À-ÿ]{4}|[–—][^\\s\\w]")


def mend(text: str) -> str:
    """For other operators: the restored text where that is possible, else the text itself."""
    return restore(text) if _MIXED.search(text) else text


def garbled(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """record_id, garbled, restored (null where nothing can be restored) of the affected rows, once per record and text."""
    suspects = rows.select(key.alias("record_id"), text.alias("garbled")).filter(F.col("record_id").isNotNull() & F.col("garbled").rlike(SUSPECT))

    def scan(batches):
        seen: dict[str, tuple[bool, str | None]] = {}
        for pdf in batches:
            if len(seen) > 20_000:
                seen.clear()
            out = [seen.get(t) or seen.setdefault(t, examine(t)) for t in pdf["garbled"]]
            hit = [o[0] for o in out]
            if any(hit):
                yield pd.DataFrame({"record_id": pdf["record_id"][hit], "garbled": pdf["garbled"][hit], "restored": [o[1] for o in out if o[0]]})

    return suspects.mapInPandas(scan, "record_id string, garbled string, restored string")


def found(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """src_table, record_id, restored of every affected record; ``sources``: name, table, key column, text column."""
    parts = [garbled(df, F.col(key), F.col(text)).select(F.lit(name).alias("src_table"), "record_id", "restored") for name, df, key, text in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src_table", "record_id").agg(F.max("restored").alias("restored"))
