"""Visually identical text with different characters: script-aware repair.

Invisible characters are dropped, odd spaces become plain ones, compatibility forms and decomposed accents are
composed. Then each token's dominant script is determined: that of the letters without a twin in another script, else
that of most letters. In a token of mixed scripts the look-alikes are substituted by those of the dominant script, and
the result stands if the corpus knows it as a word. Only rows with a character outside ASCII reach Python, and once;
the vocabulary is looked up in the JVM over every row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import lookup_join, spread, stage

# Letters of other scripts drawn like Latin ones, in the order of the Latin alphabet.
LATIN_OF = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Armenian small letters
    "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q",
}
#: The other way round, for words of another script with Latin letters in them.
CYRILLIC_OF = {b: a for a, b in LATIN_OF.items() if "CYRILLIC" in unicodedata.name(a)}
GREEK_OF = {b: a for a, b in LATIN_OF.items() if "GREEK" in unicodedata.name(a)}
# Latin letters drawn like other Latin ones that no compatibility mapping names.
SAME_SCRIPT = {"ɡ": "g", "ɑ": "a", "ı": "i", "ǃ": "!", "ⲟ": "o", "ƽ": "s"}
# Characters without ink that are not of category Cf.
BLANKS = "͏ᅟᅠ឴឵᠋᠌᠍⠀ㅤﾠ"
#: Kinds of compatibility mapping whose characters pass for the ordinary ones.
PASSING = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKENS = "array<struct<token:string,repaired:string,mixed:boolean,rank:int>>"
CHECKED = f"tbl string, row_id bigint, txt string, key bigint, form string, plain boolean, tokens {TOKENS}"


@lru_cache(maxsize=4096)
def script(ch: str) -> str:
    """The script a letter's name begins with; LATIN for letters drawn in the Latin script."""
    name = unicodedata.name(ch, "")
    return "LATIN" if name.startswith(("LATIN", "FEMININE", "MASCULINE")) else name.split(" ", 1)[0]


@lru_cache(maxsize=65536)
def ordinary(ch: str) -> str | None:
    """What stands for a single odd character in ordinary text, or None if the character is fine."""
    if ch.isascii():
        return None if ch.isprintable() or ch in "\t\n\r" else ""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in BLANKS or kind == "Cc":
        return "" if ch != "\x85" else "\n"
    if kind in ("Zs", "Zl", "Zp"):
        return "\n" if kind in ("Zl", "Zp") else " "
    if ch in SAME_SCRIPT:
        return SAME_SCRIPT[ch]
    if kind in ("Pd", "Pi", "Pf") or ch in "…‥":
        return None
    mapping = unicodedata.decomposition(ch)
    if not mapping:
        return None
    plain = unicodedata.normalize("NFKC", ch)
    if mapping.startswith("<"):
        return plain if mapping.split(" ", 1)[0] in PASSING and " " not in plain and plain != ch else None
    return plain if plain != ch else None  # a canonical twin such as the Kelvin sign


def _joins(text: str, i: int) -> bool:
    """A joiner or selector that shapes an emoji, or letters of a script that needs it, does its proper work."""
    if text[i] not in "‌‍︎️":
        return False
    around = [c for c in (text[i - 1 : i], text[i + 1 : i + 2]) if c]
    if text[i] in "︎️‍" and i and unicodedata.category(text[i - 1]) in ("So", "Sk", "Mn"):
        return unicodedata.category(text[i - 1]) != "Mn" or text[i - 1] in "︎️"
    return len(around) == 2 and all(script(c) in ("ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "MALAYALAM", "KANNADA", "SINHALA") for c in around)


def plain_form(text: str) -> tuple[str, bool]:
    """The text without invisible, compatibility and decomposed characters, and whether there were any."""
    if text.isascii() and text.isprintable():
        return text, False
    out, odd = [], False
    for i, ch in enumerate(text):
        new = None if _joins(text, i) else ordinary(ch)
        if new is None:
            out.append(ch)
        else:
            odd = True
            out.append(new)
    joined = "".join(out)
    composed = unicodedata.normalize("NFC", joined)
    return composed, odd or composed != joined


def token_repairs(text: str) -> list[tuple[str, str, bool, int]]:
    """(token, repaired, mixed, rank) of each word that look-alikes may have got into. ``mixed`` says that its letters are
    of several scripts; a word wholly of look-alikes is only a candidate. Rank 0 is the word in its dominant script: the
    one of the letters that no other script has a twin of, else the one of most letters. Where every letter has a twin,
    the word in the other script follows as rank 1."""
    found = []
    for m in WORD.finditer(text):
        word = m[0]
        letters = [c for c in word if c.isalpha()]
        scripts = {script(c) for c in letters}
        if scripts == {"LATIN"} or not letters:
            continue
        ways = []  # (letters that need no substitution and have no twin, letters of the script, word)
        for name, twins in (("LATIN", LATIN_OF), ("CYRILLIC", CYRILLIC_OF), ("GREEK", GREEK_OF)):
            if name != "LATIN" and name not in scripts:
                continue
            if all(script(c) == name or c in twins for c in letters):
                own = [c for c in letters if script(c) == name]
                other = CYRILLIC_OF.keys() | GREEK_OF.keys() if name == "LATIN" else LATIN_OF.keys()
                ways.append((sum(c not in other for c in own), len(own), "".join(twins.get(c, c) if script(c) != name else c for c in word)))
        ways.sort(key=lambda w: (-w[0], -w[1]))
        found += [(word, w, len(scripts) > 1, k) for k, w in enumerate(x for *_, x in ways if x != word)]
    return found


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("repaired", pa.string()), ("mixed", pa.bool_()), ("rank", pa.int32())]))
    names = ("token", "repaired", "mixed", "rank")
    for batch in batches:
        forms = [plain_form(t) for t in batch.column("txt").to_pylist()]
        tokens = [[dict(zip(names, x)) for x in token_repairs(f)] for f, _ in forms]
        cols = [*(batch.column(c) for c in ("tbl", "row_id", "txt", "key")), pa.array([f for f, _ in forms], pa.string()), pa.array([odd for _, odd in forms], pa.bool_()), pa.array(tokens, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["tbl", "row_id", "txt", "key", "form", "plain", "tokens"])


ODD = r"[^\x20-\x7e\t\n\r]"


def words(texts: DataFrame) -> DataFrame:
    """Every word of one script in the corpus, in lower case."""
    parts = F.explode(F.split(F.lower("txt"), r"[^\p{L}\p{M}'’]+")).alias("word")
    one = F.col("word").rlike(r"^[\p{IsLatin}\p{M}'’]+$") | F.col("word").rlike(r"^[\p{IsCyrillic}\p{M}'’]+$") | F.col("word").rlike(r"^[\p{IsGreek}\p{M}'’]+$")
    return texts.select(parts).where(one)


def known_repairs(checked: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, repaired) of the candidate tokens: the best repair that the corpus has as a word."""
    candidates = checked.select(F.explode("tokens").alias("t")).select("t.token", "t.repaired", "t.rank", F.lower("t.repaired").alias("word")).distinct()
    # The candidates are few beside the corpus: its words are cut down to them before anything is shuffled.
    met = lookup_join(words(texts), candidates.select("word").distinct(), ["word"], "left_semi").distinct()
    return candidates.join(met, "word", "left_semi").groupBy("token").agg(F.min_by("repaired", "rank").alias("repaired"))


def find_lookalikes(texts: DataFrame) -> DataFrame:
    """(tbl, row_id) of the rows with invisible or look-alike characters, each once.

    ``texts`` has tbl, row_id and txt. A row counts for an invisible, compatibility or decomposed character, for a
    token of mixed scripts whose minority letters are all look-alikes (whether or not the corpus knows the word: the
    characters are what they are), and for a token wholly of look-alikes if the corpus has the word they spell. Null
    and empty texts are no cases, nor are words truly of another script, curly quotes, dashes and ellipses. Rows that
    come twice count once; a null row_id is kept as it is.
    """
    odd = texts.select("tbl", "row_id", "txt").where(F.col("txt").rlike(ODD))
    inspected = spread(odd.withColumn("key", F.lit(0).cast("bigint"))).mapInArrow(_inspect, CHECKED).drop("form", "txt")
    checked = stage(inspected.where(F.col("plain") | (F.size("tokens") > 0)), "lookalikes")
    mixed = F.exists("tokens", lambda t: t["mixed"])
    sure = checked.where(F.col("plain") | mixed).select("tbl", "row_id")
    twins = checked.where(~F.col("plain") & ~mixed)
    tokens = twins.select("tbl", "row_id", F.explode("tokens").alias("t")).select("tbl", "row_id", "t.token")
    spelled = tokens.join(known_repairs(twins, texts).select("token"), "token", "left_semi").select("tbl", "row_id")
    return sure.unionByName(spelled).distinct()


def unify(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, txt, unified, n_repaired): every distinct row's text in one form in which equal-looking texts are equal.

    Look-alikes are substituted in tokens of mixed scripts, and in tokens wholly of look-alikes, where the corpus
    knows the result as a word; other tokens stay. Null stays null, an empty text empty.
    """
    base = texts.select("tbl", "row_id", "txt").distinct().withColumn("key", F.xxhash64("tbl", "row_id", "txt"))
    fine = F.coalesce(~F.col("txt").rlike(ODD), F.lit(True))
    plain = base.where(fine).select("tbl", "row_id", "txt", F.col("txt").alias("unified"), F.lit(0).alias("n_repaired"))
    checked = stage(base.where(~fine).mapInArrow(_inspect, CHECKED).drop("plain"), "lookalikes")
    tokens = checked.select("key", F.explode("tokens").alias("t")).select("key", "t.token").distinct()
    fixes = tokens.join(known_repairs(checked, texts), "token").groupBy("key").agg(F.collect_list(F.struct("token", "repaired")).alias("fixes"))
    fixed = checked.drop("tokens").join(fixes, "key", "left")
    done = fixed.where("fixes is null").select("tbl", "row_id", "txt", F.col("form").alias("unified"), F.lit(0).alias("n_repaired"))
    mended = fixed.where("fixes is not null").select("tbl", "row_id", "txt", "form", "fixes").mapInArrow(_apply, "tbl string, row_id bigint, txt string, unified string, n_repaired int")
    return plain.unionByName(done).unionByName(mended)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, counts = [], []
        for form, fixes in zip(batch.column("form").to_pylist(), batch.column("fixes").to_pylist()):
            swap = {x["token"]: x["repaired"] for x in fixes or [] if x}
            new = WORD.sub(lambda m, swap=swap: swap.get(m[0], m[0]), form)
            out.append(new)
            counts.append(sum(m[0] in swap for m in WORD.finditer(form)))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("tbl", "row_id", "txt")] + [pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["tbl", "row_id", "txt", "unified", "n_repaired"])
