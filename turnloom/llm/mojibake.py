"""Garbled text from wrong character encoding: round-trip repair.

Text is re-encoded under candidate legacy encodings and strictly decoded as what it may have been. Multi-byte
damage is undone sequence by sequence, single-byte damage in runs of words; a repair is accepted when a garbling
cost drops, and layers are peeled until none does. A map over rows: nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import spread

#: Encodings that UTF-8 bytes may have been read with.
AS_LEGACY = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "iso8859-15", "cp437", "cp850", "cp1254", "iso8859-2", "koi8-r", "cp866")
#: (read as, was really) of single-byte confusions.
PAIRS = tuple(
    (a, b)
    for a in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15")
    for b in ("cp1252", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "mac_roman", "cp850", "cp437")
    if a != b and {a, b} != {"cp1252", "latin-1"} and (a, b) not in (("latin-1", "cp1252"), ("iso8859-15", "cp1252"))
)
# Letters outside ASCII of the living languages of Europe written in Latin script that are common in them.
LETTERS = "àâäæçèéêëîïôœùûüÿñáíóúìòãõåøößąćęłńśźżčďěňřšťůžőűğşıșțăđýðþ"
COMMON = frozenset(LETTERS + LETTERS.upper().replace("SS", "ẞ"))
OPENING, CLOSING = "\"'«»„“”‚‘’‹›()[]{}<>*_-–—¿¡…#~/♪", "\"'«»„“”‚‘’‹›()[]{}<>*_-–—.,:;!?…%/♪"
INSIDE = frozenset("'’-–—‑.,:;/@&_·…+=#%()[]\"“”«»‘<>!?*~|\\´`")


@lru_cache(maxsize=None)
def _chars(encoding: str) -> dict[int, str]:
    """The character of each byte from 0x80; bytes the encoding leaves open stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


@lru_cache(maxsize=None)
def _bytes(encoding: str) -> dict[str, int]:
    return {c: b for b, c in _chars(encoding).items()}


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """Runs of characters whose bytes have the form of UTF-8."""
    table = _chars(encoding)

    def some(a: int, b: int) -> str:
        return "[" + "".join(re.escape(table[x]) for x in range(a, b)) + "]"

    more = some(0x80, 0xC0)
    return re.compile(f"(?:{some(0xC2, 0xE0)}{more}|{some(0xE0, 0xF0)}{more}{{2}}|{some(0xF0, 0xF5)}{more}{{3}})+")


def _utf8(run: str, encoding: str) -> str | None:
    codes = _bytes(encoding)
    try:
        return bytes(codes[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None


PACKED = re.compile("[\xc0-\xff]{2}")


@lru_cache(maxsize=200_000)
def word_cost(word: str) -> float:
    """How garbled a word looks; 0 for ordinary words of any script."""
    if word.isascii():
        return 0.0
    cost = 0.0
    core = word.lstrip(OPENING).rstrip(CLOSING)
    letters = [c for c in core if c.isalpha()]
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in letters)
    latin = sum(c < "ɐ" for c in letters)
    accented = sum("\xbf" < c < "Ā" for c in letters)
    kana = sum("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in letters)
    for i, c in enumerate(word):
        code = ord(c)
        if 0x80 <= code < 0xA0 or c == "�" or unicodedata.category(c) == "Co":
            cost += 4
        elif code == 0xAD:
            cost += 1
        elif 0x2500 <= code < 0x25A0 or code in (0x2320, 0x2321):  # frames and blocks
            cost += 3
    for i, c in enumerate(core):
        if c.isascii():
            continue
        before, after = core[i - 1 : i] if i else "", core[i + 1 : i + 2]
        if c.isalpha():
            if c in "ªº":
                cost += 0.25 if before.isdigit() or before == "." else 1
            elif c < "ɐ" and c not in COMMON or "ɐ" <= c < "Ͱ" or "Ͽ" < c < "Ѐ" or "ԯ" < c < "぀" or c > "鿿" and not "가" <= c <= "힣" or "Ѐ" <= c <= "ӿ" and not ("А" <= c <= "я" or c in "ёЁіІїЇєЄґҐўЎ"):
                cost += 1.5
            if c.isupper() and before.islower():
                cost += 1.5
            if "Ѐ" <= c <= "ӿ" and c.islower() and before.isupper() and len(core) > i + 1 and after.isupper():
                cost += 1
        elif unicodedata.category(c) in ("Mn", "Sk") and ord(c) < 0x2000 or unicodedata.category(c) in ("Cn", "No") and ord(c) > 0x100:
            cost += 4
        elif c in "™®©°" and not after and (before.isascii() and before.isalnum()):
            cost += 0.25
        elif c not in INSIDE and 0xA0 <= ord(c) < 0x2500 and not 0x300 <= ord(c) < 0x370:
            cost += 2 if before.isalpha() or after.isalpha() or not letters and len(word) == 1 and c in "ˆ˜¨¯´¸ˇ˘˙˚" else 0.25
    for a, b in zip(core, core[1:]):
        if a.islower() and b.isupper() and not (a.isascii() and b.isascii()) and b.isascii():
            cost += 1.5
        if "\x7f" < a < "ɐ" and a.isupper() and b.islower() and len(core) > 1 and core[0] != a:
            cost += 1.5 if core[1] == a and not core[0].isascii() and core[0].isupper() else 0.5  # two foreign capitals at the head
        if a in "’”“™‘„‚†‡‰‹›…ˆ˜" and a not in "’‘" and b.isalpha() and core[0] != a:
            cost += 1
    if kana and (latin or cyrillic) or 0 < kana < 2 and len(letters) > kana:
        cost += 2 * kana
    if cyrillic and latin:
        cost += 2 * min(cyrillic, latin)
    if accented >= 2 and accented > 0.5 * len(letters) and not (len(letters) < 5 and core.isupper()) and PACKED.search(core):  # été isn't
        cost += 1.5 * accented - 1.5
    if cyrillic >= 3 and letters[0].islower() and sum(c.isupper() for c in letters) > 0.6 * len(letters):
        cost += 1.0 * cyrillic  # as if KOI8 letters were read as Windows ones
    return cost


WORDS = re.compile(r"[^ \t\n\r]+")
ODD = re.compile(r"[^\x00-\x7f]")


def text_cost(text: str) -> float:
    """The cost of all words with characters outside ASCII."""
    return sum(word_cost(w) for w in WORDS.findall(text) if not w.isascii())


def _undo_utf8(text: str, encoding: str) -> str | None:
    """The text with every run of UTF-8 bytes read as ``encoding`` decoded where that lowers the cost of its word.
    Once one word has shown the encoding, words of Latin letters are decoded too if that costs nothing."""
    pattern = _sequences(encoding)
    if not pattern.search(text):
        return None
    shown = False

    def repair(m: re.Match) -> str:
        nonlocal shown
        word = m[0]
        if word.isascii():
            return word
        new = pattern.sub(lambda s: _utf8(s[0], encoding) or s[0], word)
        if new == word:
            return word
        old, cost = word_cost(word), spread_cost(new)
        if cost <= old - 1:
            shown = True
            return new
        return new if again and cost <= old and not CYRILLIC.search(word) else word

    # Non-breaking spaces are bytes here, so words end at ASCII blanks only.
    again = False
    new = WORDS.sub(repair, text)
    if not shown:
        return None
    again = True
    return WORDS.sub(repair, new)


CYRILLIC = re.compile("[\u0400-\u04ff]")


def spread_cost(word: str) -> float:
    """The cost of a repaired word, which may have blanks in it."""
    return sum(word_cost(w) for w in word.split()) if word.split() else 0.0


def _recode(word: str, read: str, real: str) -> str | None:
    codes, table = _bytes(read), _chars(real)
    out = []
    for c in word:
        if c.isascii():
            out.append(c)
        elif c in codes:
            out.append(table[codes[c]])
        else:
            return None
    return "".join(out)


def _undo_pair(text: str, read: str, real: str) -> tuple[str, float] | None:
    """Words re-read as ``real``, in runs: a run ends at a word that a re-reading would spoil."""
    runs: list[tuple[float, int, list[tuple[int, int, str]]]] = []
    drop, good, edits = 0.0, 0, []
    mild = not CYRILLIC.search(_chars(real)[0xE0] + _chars(real)[0xC0] + _chars(read)[0xE0] + _chars(read)[0xC0] + _chars(real)[0x80])
    for m in WORDS.finditer(text):
        word = m[0]
        if word.isascii():
            continue
        old, new = word_cost(word), _recode(word, read, real)
        gain = old - word_cost(new) if new is not None else -9.0
        if gain < 0 or new == word:
            if edits:
                runs.append((drop, good, edits))
            drop, good, edits = 0.0, 0, []
            continue
        drop += gain
        good += gain >= 1
        edits.append((m.start(), m.end(), new))
    if edits:
        runs.append((drop, good, edits))
    out, at, total = [], 0, 0.0
    for drop, good, edits in runs:
        left = sum(word_cost(new) for _, _, new in edits)
        sure = good >= 2 and drop >= 3 or good and drop >= 6 and not mild or good == len(edits) == 1 and drop >= 1.5 and mild and not left and not text[edits[0][0] : edits[0][1]].isupper()
        if sure and drop / len(edits) >= 0.2 and left <= 0.3 * len(edits):
            total += drop
            for a, b, new in edits:
                out += [text[at:a], new]
                at = b
    if not total:
        return None
    return "".join(out) + text[at:], total


def restore(text: str) -> tuple[str, list[str]]:
    """The text with its garbled stretches undone as far as can be, and the encodings it had been read with."""
    layers: list[str] = []
    while True:  # every layer lowers the cost by 1 at least
        now = text_cost(text)
        if now < 1:
            break
        tried = [(new, f"utf-8 as {e}") for e in AS_LEGACY if (new := _undo_utf8(text, e)) is not None]
        if not tried or min(text_cost(new) for new, _ in tried) >= 1:
            tried += [(got[0], f"{real} as {read}") for read, real in PAIRS if (got := _undo_pair(text, read, real))]
        best = min(((text_cost(new), len(new), new, name) for new, name in tried), key=lambda x: x[:2], default=None)
        if best is None or best[0] > now - 1:
            break
        text = best[2]
        layers.append(best[3])
    return text, layers


LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def garbled(text: str) -> tuple[str, list[str], bool]:
    """(restored text, layers, affected). A lost character (U+FFFD, a C1 control) is a garbling cost no round trip can
    lower: the text is affected then, whether or not anything else could be restored."""
    new, layers = restore(text)
    return new, layers, bool(layers) or bool(LOST.search(text))


OUT = "doc_id bigint, restored string, layers array<string>, complete boolean"


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            new, layers, hit = garbled(text)
            if hit:
                rows.append((doc_id, new, layers, not LOST.search(new)))
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "restored", "layers", "complete"])


def repair_garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The affected rows: doc_id, restored (the whole text, repaired as far as can be), layers (what was undone, outermost
    first; empty if nothing could be), complete (no lost character is left).

    Rows with null, empty or plain ASCII text are no cases and never reach Python. Rows that come twice come out
    twice. Texts of any length are handled whole.
    """
    odd = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return spread(odd).mapInArrow(_map, OUT)
