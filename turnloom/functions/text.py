"""Text scalars as column expressions; Python only where Unicode normalisation has no built-in counterpart."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases that mark a row as a song rather than speech.
SONG_MARKERS = ("theme song", "theme from", "i'll be there for you", "if you ever need", "when the rain starts to pour", "your job's a joke", "your love life's doa")
# Fixed pattern: a row that is only a short reaction.
REACTION = r"^(la+|ha+|o+h+|ah+|uh+|um+|hmm+)[.!?]*$"
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
BRACKETS = r"\([^)]*\)|\[[^\]]*\]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def clean(text: Column) -> Column:
    """Stripped, with null as the empty string."""
    return F.coalesce(strip(text), F.lit(""))


def blank_to_null(text: Column) -> Column:
    """Stripped, with what is blank as null."""
    return F.nullif(strip(text), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII passes untouched."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def plain_quotes(text: Column) -> Column:
    """Curly quotes and apostrophes as straight ones."""
    return F.translate(text, "’‘“”", "''\"\"")


def match_form(composed: Column) -> Column:
    """``normalize_for_match`` of a text that is already composed and has straight quotes."""
    return collapse(F.regexp_replace(F.regexp_replace(strip(F.lower(composed)), BRACKETS, " "), r"[^a-z0-9' ]", " "))


def match_form(composed: Column) -> Column:
    """``normalize_for_match`` of a text that is already composed and has straight quotes."""
    return collapse(F.regexp_replace(F.regexp_replace(strip(F.lower(composed)), BRACKETS, " "), r"[^a-z0-9' ]", " "))


#: Of each byte of a lowered text what the forms for matching keep, with apostrophes and without; a space for all else.
KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for c in range(256))
KEPT_BARE = KEPT.replace(b"'", b" ")
QUOTES = str.maketrans("’‘“”", "''\"\"")


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).translate(QUOTES).lower()


def match_words(text: str | None) -> str:
    """``normalize_for_match`` of one text."""
    low = _lowered(text or "")
    if "(" in low or "[" in low:
        low = re.sub(BRACKETS, " ", low)
    return b" ".join(low.encode("ascii", "replace").translate(KEPT).split()).decode()


def speaker_words(name: str | None) -> str:
    """``normalize_speaker`` of one name."""
    return b" ".join(_lowered(name or "").encode("ascii", "replace").translate(KEPT_BARE).split()).decode()


@F.pandas_udf(StringType())
def normalize_for_match(text: pd.Series) -> pd.Series:
    """The form two spellings of a line are compared in: compatibility-composed, lower case, without bracketed
    remarks, only a-z, 0-9 and apostrophes. Null becomes the empty string."""
    return pd.Series([match_words(x) for x in text], dtype="object")


@F.pandas_udf(StringType())
def normalize_speaker(name: pd.Series) -> pd.Series:
    """The form speaker names are compared in: as for lines, but without apostrophes and with remarks kept."""
    return pd.Series([speaker_words(x) for x in name], dtype="object")


def normalize_rule(text: Column) -> Column:
    """The form the imputation rules read: built-ins only, no compatibility composition."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BRACKETS, " "), "’`", "''")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9']+", " "))


def word_count(text: Column) -> Column:
    """How many runs of letters, digits and underscores; an apostrophe parts words."""
    return F.coalesce(F.regexp_count(clean(text), F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def row_type(text: Column, song_markers: Sequence[str] = SONG_MARKERS) -> Column:
    """empty, direction, song, reaction or dialogue: the first that holds."""
    bare, low = clean(text), F.lower(clean(text))
    song = F.lit(False)
    for marker in song_markers:
        song = song | F.contains(low, F.lit(marker))
    return (
        F.when(bare == "", "empty")
        .when(bare.rlike(r"^(\[[^\n]*\]|\([^\n]*\))$"), "direction")
        .when(song, "song")
        .when(low.rlike(REACTION), "reaction")
        .otherwise("dialogue")
    )


def mentions(text: Column, names: Column) -> Column:
    """Those of an array of names that stand as whole words in the rule form of the text. A name with punctuation
    is never found, as the form has none."""
    padded = F.concat(F.lit(" "), normalize_rule(text), F.lit(" "))
    return F.filter(names, lambda n: (clean(n) != "") & F.contains(padded, F.concat(F.lit(" "), F.lower(clean(n)), F.lit(" "))))


def confidence_bucket(similarity: Column, matched: Column) -> Column:
    """struct(confidence, method) of an alignment."""
    named = lambda a, b: F.struct(F.lit(a).alias("confidence"), F.lit(b).alias("method"))
    return F.when(~F.coalesce(matched, F.lit(False)), named("unresolved", "none")).when(similarity >= 0.85, named("high", "exact_align")).when(similarity >= 0.60, named("medium", "fuzzy_align")).otherwise(named("low", "fuzzy_align"))


def split_chunks(text: Column) -> Column:
    """array<struct<raw,norm>> of the sentence-like chunks of a line: compatibility-composed, cut at . ! ? ; after brackets
    are dropped; pieces without a word are left out."""
    bare = F.regexp_replace(F.coalesce(plain_quotes(nfkc(text)), F.lit("")), BRACKETS, " ")
    parts = F.transform(F.split(F.replace(bare, F.lit("..."), F.lit(". ")), r"[.!?;]+"), lambda p: F.regexp_replace(collapse(p), r"^[ ,:\-]+|[ ,:\-]+$", ""))
    both = F.transform(parts, lambda p: F.struct(p.alias("raw"), match_form(p).alias("norm")))
    return F.filter(both, lambda c: c["norm"] != "")


def append_note(old: Column, new: Column) -> Column:
    """The old note with the new one behind a bar, unless it has it already."""
    was = clean(old)
    return F.when(was == "", new).when(F.contains(was, new), was).otherwise(F.concat(was, F.lit(" | "), new))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first: o'brien becomes O'Brien."""
    pieces = F.regexp_extract_all(strip(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def mapped_speaker(label: Column, names: Column) -> Column:
    """The title-cased label, or what a map of title-cased labels has for it."""
    titled = title_case(label)
    return F.coalesce(F.element_at(names, titled), titled)


def episode_root(episode: Column) -> Column:
    """The episode key without its part letters; a key of another form stays as it is."""
    found = F.regexp_extract(F.lower(strip(episode)), r"^(.*s\d+e\d+)[a-z]*$", 1)
    return F.when(found != "", found).otherwise(F.lower(strip(episode)))


def episode_key(episode: Column, prefix: str) -> Column:
    """Lower case, with the series prefix put before a key that lacks it."""
    low = F.lower(strip(episode))
    return F.when(low.startswith(prefix), low).otherwise(F.concat(F.lit(prefix), low))


def season_of(episode: Column) -> Column:
    """``sN`` of an episode or season key, without leading zeros; null if there is none."""
    digits = F.regexp_extract(F.lower(episode), r"(?:^|_)s?0*(\d+)(?:e\d+[a-z]*)?$", 1)
    return F.when(digits != "", F.concat(F.lit("s"), digits))


def series_of(episode: Column) -> Column:
    """The piece of an episode key before ``_s``."""
    return F.nullif(F.regexp_extract(episode, r"^(.*?)_s\d", 1), F.lit(""))
