"""Variant spellings of names typed by people: noisy-channel attribution.

Frequent spellings are the candidate canonical forms: candidates are ranked by frequency among spellings equally
complete (a shortened spelling is no canonical form of a fuller one). A variant meets only candidates that share a
blocking key with it. Each is scored by its frequency prior times the likelihood that typing it gave the variant: by
typos, initials, abbreviations, nicknames, titles, turned order, acronyms. How likely each of these is comes from the
corpus by expectation-maximisation, and so do nicknames, by names used for one surname in the same series or typed in
quotes. The variant is attached to its maximum posterior, unless a person of its own, known from how the corpus uses
the name's words, explains it better. Attachments only lead up the ranking; their roots are the names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import lookup_join, stage
from turnloom.session import shuffle_partitions

# Titles before a surname.
TITLES = frozenset("dr doctor mr mrs ms miss prof professor judge officer captain capt sergeant sgt lieutenant lt rev reverend father sister sir lady lord dame coach nurse detective mayor president senator inspector chief aunt uncle".split())
# Words that end or mark names of organisations, with their abbreviations.
ORG_WORDS = {
    "association": "assn assoc", "company": "co", "corporation": "corp", "department": "dept", "center": "ctr centre", "station": "stn sta", "institute": "inst", "university": "univ", "insurance": "ins", "committee": "cttee",
    "society": "soc", "theatre": "theater thtr", "medical": "med", "police": "", "radio": "", "savings": "sav svgs", "bank": "bk", "council": "", "agency": "", "incorporated": "inc", "limited": "ltd", "hospital": "hosp", "school": "sch",
    "municipal": "mun muni", "regional": "reg", "community": "comm", "central": "cent cen", "national": "nat natl", "international": "intl",
}
ABBREVIATED = {short: full for full, shorts in ORG_WORDS.items() for short in shorts.split()}
ORG_SURE = frozenset("association assn assoc company co corporation corp department dept center ctr centre station stn institute inst university univ insurance theatre theater medical police radio savings bank council agency inc ltd hospital municipal committee society".split())
# Common English nicknames that aren't the beginning of the name, by name. A prior only; more are learnt.
NICKNAMES = {
    "abigail": "gail", "adelaide": "heidi", "albert": "bert bertie", "alexander": "sandy sasha xander", "alexandra": "sandra sandy sasha", "alfred": "fred", "andrew": "drew", "anne": "nan nancy", "anthony": "tony", "augustus": "gus",
    "beatrice": "trixie", "bernard": "barney", "catherine": "kate kathy kitty", "charles": "chuck", "charlotte": "lottie", "christina": "tina", "christopher": "kit topher", "clarence": "larry", "cynthia": "cindy", "deborah": "deb",
    "dorothy": "dot dottie dolly", "edmund": "ned ted", "edward": "ned ted teddy", "eleanor": "nell ellie nora", "elizabeth": "beth betty betsy liz lizzie lisa libby bess", "emily": "millie", "eugene": "gene", "florence": "flossie",
    "frances": "fanny", "francis": "frank frankie", "frederick": "fritz", "george": "dodie", "gerald": "jerry", "gilbert": "bert", "harold": "hal harry", "helen": "nell nellie", "henrietta": "hettie etta hattie", "henry": "hal harry hank",
    "herbert": "bert", "isabella": "bella", "jacob": "jake", "james": "jim jimmy jamie", "jane": "jenny", "jerome": "jerry", "john": "jack johnny", "jonathan": "nathan", "josephine": "jo josie", "katherine": "kit kitty kate kathy",
    "lawrence": "larry laurie", "leonard": "len lenny", "lucinda": "cindy lucy", "margaret": "peggy meg maggie daisy greta rita", "marjorie": "marge margie", "martha": "patsy mattie", "mary": "molly polly", "matilda": "tilly", "matthew": "matt",
    "michael": "mike mick", "nathaniel": "nat nate", "nicholas": "claus", "patricia": "trish tricia patty", "philip": "pip", "rebecca": "becca becky", "richard": "dick rick ricky", "robert": "bob bobby rob", "rosalind": "roz",
    "sarah": "sally sadie", "stephen": "steve", "susan": "sukie", "theodora": "dora", "theodore": "ted teddy theo", "thomas": "tommy", "victoria": "vicky tori", "virginia": "ginny", "walter": "wat", "wilhelmina": "mina billie minnie",
    "william": "bill billy liam will",
}
#: What typing can do to a name, and how likely each is before the corpus is asked.
OPS = {"typo": 0.03, "short": 0.05, "nick": 0.3, "missing": 0.03, "turned": 0.2, "dropped": 0.08, "acronym": 0.05}
#: Labels that the prior of these weighs as much as, and rounds of estimation.
OP_WEIGHT, OP_ROUNDS = 200.0, 3
#: Families that two given names must share, and the share of the rarer one's families, to be learnt as name and nickname.
NICK_FAMILIES, NICK_SHARE = 3, 0.6
LOG_NEW = math.log(0.3)
NEVER = -1e9
#: Labels of a block that one task takes as variants.
BLOCK = 256


class Name(NamedTuple):
    """A parsed spelling: ``org`` words or ways to read it as (given, surname, how often turned); a trailing ``*`` marks a
    shortened part."""

    org: tuple[str, ...]
    acronym: str
    ways: tuple[tuple[str, str, float], ...]
    level: int  # 3 both parts in full, 2 one of them shortened, 1 one part only
    quoted: str = ""  # a nickname in quotes


def fold(text: str) -> str:
    """Lower case without accents."""
    flat = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in flat if not unicodedata.combining(c)).translate({0xF8: "o", 0x142: "l", 0xDF: "ss", 0xE6: "ae", 0x111: "d"})


NICK_OF = {}
for _full, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        NICK_OF.setdefault(_n, set()).add(fold(_full))


@lru_cache(maxsize=100_000)
def parse(label: str) -> Name | None:
    """The parts of a spelling; None if it has no letter."""
    text = re.sub(r"[’`]", "'", label).strip()
    text = re.sub(r"\s*[\[(](?:v\.?o\.?|o\.?s\.?|cont'?d|on phone)[\])]", "", text, flags=re.I)
    nick = ""
    if m := re.search(r"[\"“'(]([^\"”')(]+)[\"”')]", text):
        rest = (text[: m.start()] + " " + text[m.end() :]).strip()
        head = rest.replace(".", "").strip()
        if re.fullmatch(r"[A-Za-z]{2,6}", head) and head.isupper():  # ABCD (Brand)
            return Name((fold(m[1]).strip(),), fold(head), (), 1)
        if len(rest.split()) >= 2:
            nick, text = fold(m[1]).strip(), rest
    parts = [p.strip() for p in text.split(",") if p.strip()]
    raw = (" ".join(parts[1:] + parts[:1]) if len(parts) > 1 else text).split()
    words = [(re.sub(r"[^\w']", "", fold(w)).replace("'", ""), w) for w in raw]
    words = [(w, r) for w, r in words if any(c.isalnum() for c in w)]
    if not words:
        return None
    if words[0][0] == "the" and len(words) > 1:
        words = words[1:]
    for (w, r), (b, _) in ((words[0], words[-1]), (words[-1], words[0])):
        if len(words) == 2 and re.fullmatch(r"(?:\w\.){3,6}", r):
            return Name((b,), w, (), 1)
    if len(words) >= 2 and any(w in ORG_SURE for w, _ in words):
        org = tuple(ABBREVIATED.get(w, w) if w in ABBREVIATED and w not in ("cen", "reg", "nat", "mun", "comm") else w + "*" if r.endswith(".") else w for w, r in words)
        return Name(org, "", (), 3 if len(org) > 2 and not any(w.endswith("*") for w in org) else 2)
    titled = words[0][0] in TITLES and len(words) > 1
    if titled:
        words = words[1:]

    def part(k: int) -> str:
        w, r = words[k]
        return w + "*" if len(w) == 1 or r.endswith(".") and len(w) <= 4 else w

    if len(words) == 1:
        one = part(0)
        return Name((), "", ((("", one, 0.0),) if titled else ((one, "", 0.0), ("", one, 2.0))), 1)
    g, s = part(0), part(-1)
    ways = [(g, s, 0.0)]
    if nick:
        ways.append((nick, s, 0.06))
    if len(parts) == 1 and not nick and not titled:
        ways.append((s, g, 1.0))
    return Name((), "", tuple(ways), 2 if g.endswith("*") or s.endswith("*") else 3, nick)


@lru_cache(maxsize=500_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=100_000)
def is_nickname(nick: str, name: str) -> bool:
    """By the list, or as the beginning of the name, with a doubled letter or an ending of endearment."""
    if name in NICK_OF.get(nick, ()):
        return True
    if len(nick) >= len(name) + 2 or len(nick) < 2 or len(name) < 4:
        return False
    stem = re.sub(r"(?:ie|y|i)$", "", nick)
    bare = stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else stem
    return len(bare) >= 2 and name != nick and len(stem) < len(name) and (name.startswith(stem) or name.startswith(bare)) and (len(stem) >= 3 or stem != nick or len(nick) <= 3)


Ops = tuple[float, ...]
NAMES = tuple(OPS)
PRIOR = tuple(math.log(p) for p in OPS.values())
NONE: Ops = (0.0,) * len(NAMES)


def ops(**counts: float) -> Ops:
    """How often each thing happened, in the order of ``OPS``."""
    return tuple(counts.get(n, 0.0) for n in NAMES)


def plus(a: Ops, b: Ops, times: float = 1.0) -> Ops:
    return tuple(x + times * y for x, y in zip(a, b))


def weigh(counts: Ops) -> float:
    """log likelihood before the corpus is asked: what chooses among ways to read two spellings."""
    return sum(n * p for n, p in zip(counts, PRIOR))


def _part(v: str, c: str, given: bool, nicks: bool = False) -> tuple[Ops | None, int]:
    """What happened to one part of a name that is ``v`` where the canonical form has ``c``, and the typos; None if
    nothing explains it. ``nicks`` says that the corpus knows the two as name and nickname."""
    if v == c:
        return NONE, 0
    if not v or not c:
        return ops(missing=1), 0
    a, b = v.rstrip("*"), c.rstrip("*")
    if v.endswith("*") or c.endswith("*"):
        short, full = (a, b) if len(a) <= len(b) else (b, a)
        return (ops(short=1), 0) if full.startswith(short) else (None, 9)
    if given and (nicks or is_nickname(a, b) or is_nickname(b, a)):
        return ops(nick=1), 0
    if min(len(a), len(b)) < 4:
        k = edits(a, b, 1)
        return (ops(typo=1.5), 1) if k <= 1 and max(len(a), len(b)) > 3 else (None, 9)
    most = 2 if min(len(a), len(b)) > 4 else 1
    k = edits(a, b, most)
    return (ops(typo=k), k) if k <= most else (None, 9)


def channel(v: Name, c: Name, nicks: frozenset[tuple[str, str]] = frozenset()) -> Ops | None:
    """What happened in typing the variant for the canonical form, read the likeliest way; None if nothing explains it.
    ``nicks`` has pairs of given names the corpus knows as name and nickname."""
    if bool(v.org) != bool(c.org):
        return None
    if v.org:
        return _org_channel(v, c)
    found: list[Ops] = []
    for vg, vs, vp in v.ways:
        for cg, cs, cp in c.ways:
            if not (vg and cg or vs and cs):
                continue
            a, ka = _part(vg, cg, True, (vg, cg) in nicks or (cg, vg) in nicks)
            b, kb = _part(vs, cs, False)
            if a is not None and b is not None and ka + kb <= 3 and not (not vs and not cs and ka > 1):
                found.append(plus(plus(a, b), ops(turned=1), vp + cp))
    return max(found, key=weigh, default=None)


def _org_channel(v: Name, c: Name) -> Ops | None:
    if v.acronym or c.acronym:
        if v.acronym and c.acronym:
            return ops(typo=0.5) if v.acronym == c.acronym and edits(v.org[0], c.org[0], 1) <= 1 else None
        short, full = (v, c) if v.acronym else (c, v)
        initials = "".join(w[0] for w in full.org)
        return ops(acronym=1) if initials == short.acronym and edits(full.org[0], short.org[0], 1) <= 1 else None
    total, typos, extra, free = NONE, 0, 0, list(c.org)
    for w in v.org:
        best: tuple[float, str, Ops, int] | None = None
        for x in free:
            p, n = _part(w, x, False)
            if p is not None and (best is None or weigh(p) > best[0]):
                best = weigh(p), x, p, n
        if best is None:
            total, extra = plus(total, ops(dropped=2)), extra + 1  # a word the canonical form lacks
            continue
        free.remove(best[1])
        total, typos = plus(total, best[2], 0.5 if w.endswith("*") else 1.0), typos + best[3]
    if extra > 1 or extra and free:
        return None
    if all(_part(w, c.org[0], False)[0] is None for w in v.org) or len(free) > 2 or typos > 3 or len(v.org) < 2:
        return None
    return plus(total, ops(dropped=len(free)))


def _without_one(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def block_keys(name: Name) -> list[str]:
    """Keys one of which a variant shares with what it may be a variant of."""
    keys: set[str] = set()
    if name.org:
        brands = set(name.org[:1]) | ({w for w in name.org if w.rstrip("*") not in ORG_WORDS} if not name.acronym else set())
        for b in brands:
            b = b.rstrip("*")
            keys |= {f"o:{b}", *(f"o-{x}" for x in {b, *_without_one(b)})}
        return sorted(keys)
    for g, s, _ in name.ways:
        gb, sb = g.rstrip("*"), s.rstrip("*")
        if s and not s.endswith("*"):
            keys.add(f"s:{s}")
            if g:
                keys |= {f"d:{gb[0]}:{x}" for x in {s, *_without_one(s)}}
            else:
                keys |= {f"t:{x}" for x in {s, *_without_one(s)}}
        if g and not g.endswith("*"):
            keys.add(f"g:{g}")
            if s:
                keys |= {f"e:{x}:{sb[0]}" for x in {g, *_without_one(g)}}
            stem = re.sub(r"(?:ie|y|i)$", "", g)
            near = {g, *NICK_OF.get(g, ()), g[:3]} | ({stem[:3], stem[:2]} if len(g) <= 6 else {g[:2]})
            keys |= {f"n:{x}" for x in near}  # of a full name, only for those who have a given name alone
            if s:
                keys |= {f"m:{x}:{sb[0]}" for x in near}
        if g and s and not s.endswith("*") and len(s) > 4:
            keys |= {f"p:{gb[0]}:{s[:3]}"}
    return sorted(keys)


def words_of(name: Name) -> list[str]:
    """The words in full that a spelling is made of."""
    return sorted({w for way in name.ways for w in way[:2] if w and not w.endswith("*")} | {w for w in name.org if not w.endswith("*")})


PARSED = "label_id bigint, series string, label string, level int, keys array<string>, words array<string>, given string, surname string, quoted string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [parse(x) if x else None for x in batch.column("label").to_pylist()]
        first = [n.ways[0] if n and n.ways else ("", "", 0.0) for n in names]
        plain = lambda part: [w[part] if w[part] and not w[part].endswith("*") else None for w in first]
        cols = [pa.array([n.level if n else 0 for n in names], pa.int32()), pa.array([block_keys(n) if n else [] for n in names], pa.list_(pa.string())), pa.array([words_of(n) if n else [] for n in names], pa.list_(pa.string()))]
        cols += [pa.array(x, pa.string()) for x in (plain(0), plain(1), [n.quoted or None if n else None for n in names])]
        yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("series"), batch.column("label"), *cols], names=[x.split()[0] for x in PARSED.split(", ")])


SCORED = "v_id bigint, c_id bigint, prior double, ops array<double>, alone double"


def own_person(v: Name, c: Name, known: dict[str, float], total: float) -> float:
    """log of how well two persons explain the two spellings: a relative or namesake who shares a part, otherwise
    somebody new. A word is as likely as the corpus uses it elsewhere, and of the two words in which the spellings
    differ the rarer one counts, whichever of them is the slip. Two persons of one full name are not considered."""

    def rare(a: str, b: str) -> float:
        return min(math.log((known.get(w, 0.0) + 0.1) / total) if w and not w.endswith("*") else 0.0 for w in (a, b))

    if v.org:
        return LOG_NEW + 3 * math.log(0.02)
    best = NEVER
    for g, s, turned in v.ways:
        for cg, cs, again in c.ways:
            p = (turned + again) * PRIOR[NAMES.index("turned")]
            if g == cg and s == cs:
                return NEVER
            if not g or not s or g.endswith("*") or s.endswith("*"):
                score = LOG_NEW + math.log(0.02) + (rare(g, "") if not s or s.endswith("*") else rare(s, ""))
            else:
                score = LOG_NEW + p + (0.0 if g == cg else rare(g, cg)) + (0.0 if s == cs else rare(s, cs))
            best = max(best, score)
    return best


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("v_id", "c_id", "v_label", "c_label", "v_known", "c_known", "nicks", "v_given", "c_given", "c_freq", "series_freq", "series_labels", "total")
    for batch in batches:
        out = []
        for v_id, c_id, v_label, c_label, v_known, c_known, nicks, v_given, c_given, freq, series_freq, series_labels, total in zip(*(batch.column(n).to_pylist() for n in names)):
            v, c = parse(v_label), parse(c_label)
            if not v or not c:
                continue
            happened = channel(v, c, frozenset([(v_given, c_given)]) if nicks else frozenset())
            if happened is None:
                continue
            known = {x["word"]: x["support"] for x in [*(v_known or []), *(c_known or [])]}
            prior = math.log((freq + 3.0) / (series_freq + 3.0 * series_labels))
            prior = max(prior, math.log(1.5 / max(3, series_labels)))  # a rare spelling may be that of a frequent person
            out.append((v_id, c_id, prior, happened, own_person(v, c, known, max(200.0, total))))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCORED.split(", ")])


def learnt_nicknames(base: DataFrame) -> DataFrame:
    """(a, b), both ways round, of given names that go with one surname in the same series so often that they must be
    name and nickname, or of which one stands in quotes behind the other. Counted over families, of which each gives
    the distinct given names it has."""
    family = base.where("series is not null and level = 3 and given is not null and surname is not null").select("series", "surname", "given").distinct()
    n = family.groupBy("given").agg(F.count("*").alias("n"))
    both = family.withColumnRenamed("given", "a").join(family.withColumnRenamed("given", "b"), ["series", "surname"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    often = both.where(F.col("k") >= NICK_FAMILIES).join(n.select(F.col("given").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("given").alias("b"), F.col("n").alias("n_b")), "b").where(F.col("k") >= NICK_SHARE * F.least("n_a", "n_b"))
    quoted = base.where("quoted is not null and given is not null and quoted <> given").select(F.least("given", "quoted").alias("a"), F.greatest("given", "quoted").alias("b"))
    found = often.select("a", "b").unionByName(quoted).distinct()
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def estimated(pairs: DataFrame, n_labels: int, rounds: int = OP_ROUNDS) -> list[float]:
    """log likelihood of each of ``OPS`` by expectation-maximisation over scored pairs: how often it happened among the
    attachments expected under the last estimate. One row of as many sums as there are operations reaches the driver."""
    theta = list(PRIOR)
    for _ in range(rounds):
        score = F.exp(F.least(F.col("prior") + likelihood(theta), F.lit(0.0)))
        with_score = pairs.select("v_id", "ops", score.alias("w"), F.exp(F.least("alone", F.lit(0.0))).alias("own"))
        of_label = with_score.groupBy("v_id").agg((F.sum("w") + F.max("own")).alias("all"), *[F.sum(F.col("w") * F.col("ops")[i]).alias(f"s{i}") for i in range(len(NAMES))])
        row = of_label.agg(*[F.sum(F.try_divide(F.col(f"s{i}"), F.col("all"))).alias(f"s{i}") for i in range(len(NAMES))]).collect()[0]
        theta = [math.log(min(0.9, ((row[f"s{i}"] or 0.0) + OP_WEIGHT * math.exp(p)) / (n_labels + OP_WEIGHT))) for i, p in enumerate(PRIOR)]
    return theta


def likelihood(theta: list[float]) -> Column:
    """log P(variant | canonical) of a scored pair."""
    total = F.lit(0.0)
    for i, p in enumerate(theta):
        total = total + F.col("ops")[i] * F.lit(p)
    return total


def spelling_key(label: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "")


def spelling_counts(uses: DataFrame) -> DataFrame:
    """(series, key, uses) of (series, label) rows, with and without bracketed remarks; counted before the shuffle."""
    bare = F.regexp_replace("label", r"\([^)]*\)|\[[^\]]*\]", "")
    both = uses.select("series", F.explode(F.array_distinct(F.array(spelling_key(F.col("label")), spelling_key(bare)))).alias("key"))
    return both.where("key is not null and key <> ''").groupBy("series", "key").agg(F.count("*").alias("uses"))


def attribute(labels: DataFrame, uses: DataFrame) -> DataFrame:
    """(label_id, series, root_id): the canonical spelling each spelling is attached to, itself if it stands alone.

    ``labels`` has label_id, series and label, ``uses`` a row (series, label) for each time a label was typed. Labels
    that are null or have no letter, and rows with null series, stand alone; so does a spelling that nobody explains
    better than a person of its own. Rows that come twice count once, and of several labels with one label_id the least.
    """
    n = shuffle_partitions(labels.sparkSession)
    once = labels.where("label_id is not null").groupBy("label_id").agg(F.min(F.struct("series", "label")).alias("x")).select("label_id", "x.series", "x.label")
    counted = spelling_counts(uses)
    parsed = once.repartition(n, "label_id").mapInArrow(_parse, PARSED)
    frequent = lookup_join(parsed.withColumn("key", spelling_key(F.col("label"))), counted, ["series", "key"], salt_by="label_id")
    base = stage(frequent.select(*parsed.columns, F.coalesce("uses", F.lit(0)).alias("freq")), "labels")
    good = base.where("series is not null and level > 0")
    by_series = good.groupBy("series").agg(F.sum("freq").alias("series_freq"), F.count("*").alias("series_labels"))
    word = good.select("label_id", "series", F.explode("words").alias("word"))
    in_series = word.groupBy("series", "word").agg(F.count("*").alias("n_labels"))
    over = in_series.groupBy("word").agg(F.count("*").alias("n_series"))
    total = good.agg(F.count("*").alias("total"))
    support = in_series.join(over, "word").select("series", "word", ((F.col("n_series") - 1) + 0.5 * (F.col("n_labels") - 1)).alias("support"))
    known = lookup_join(word, support, ["series", "word"], salt_by="label_id").groupBy("label_id").agg(F.collect_list(F.struct("word", "support")).alias("known"))
    seen = F.coalesce(F.array_min(F.transform("known", lambda x: x["support"])), F.lit(0.0)) >= 0.5  # every word has other uses
    rank = F.struct(F.col("level"), F.col("freq"), seen.alias("seen"), (-F.col("label_id")).alias("id"))
    ranked = stage(good.join(known, "label_id", "left").select("label_id", "series", "label", "level", "freq", "known", rank.alias("rank"), "keys", "given", "surname", "quoted"), "ranked")
    nicks = stage(learnt_nicknames(ranked), "nicknames")
    # Blocks: narrow rows meet; of a block of many labels the variants are dealt out and the candidates copied to each part.
    alone = F.col("surname").isNull() & F.col("given").isNotNull()
    by_nick = lookup_join(ranked.where(alone).select("label_id", "series", "level", "rank", F.col("given").alias("a")), nicks, ["a"], "inner", salt_by="label_id")
    side = ranked.select("label_id", "series", "level", "rank", F.explode("keys").alias("key")).unionByName(by_nick.select("label_id", "series", "level", "rank", F.concat(F.lit("n:"), "b").alias("key")))
    sizes = side.groupBy("series", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    parts = lookup_join(side, sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK)).drop("n"), ["series", "key"], salt_by="label_id").withColumn("parts", F.coalesce("parts", F.lit(1)))
    v = parts.where(~F.col("key").startswith("n:") | (F.col("level") == 1)).select("series", "key", F.pmod(F.xxhash64("label_id"), F.col("parts")).alias("part"), F.col("label_id").alias("v_id"), F.col("rank").alias("v_rank"))
    c = parts.select("series", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("label_id").alias("c_id"), F.col("rank").alias("c_rank"))
    met = v.join(c, ["series", "key", "part"]).where("c_rank > v_rank").select("v_id", "c_id").distinct()
    facts = ranked.select("label_id", "series", "label", "freq", "known", "given")
    one = lookup_join(met, facts.select(F.col("label_id").alias("v_id"), "series", F.col("label").alias("v_label"), F.col("known").alias("v_known"), F.col("given").alias("v_given")), ["v_id"], "inner")
    two = lookup_join(one, facts.select(F.col("label_id").alias("c_id"), F.col("label").alias("c_label"), F.col("known").alias("c_known"), F.col("freq").alias("c_freq"), F.col("given").alias("c_given")), ["c_id"], "inner")
    told = lookup_join(two, nicks.select(F.col("a").alias("v_given"), F.col("b").alias("c_given"), F.lit(True).alias("nicks")), ["v_given", "c_given"], salt_by="v_id").withColumn("nicks", F.coalesce("nicks", F.lit(False)))
    whole = lookup_join(told, by_series.crossJoin(total), ["series"], salt_by="v_id")  # total is one row
    scored = stage(whole.repartition(n, "v_id", "c_id").mapInArrow(_score, SCORED), "scored")
    theta = estimated(scored, good.count())
    rated = scored.select("v_id", "c_id", (F.col("prior") + likelihood(theta)).alias("score"), "alone")
    best = rated.groupBy("v_id").agg(F.max(F.struct("score", F.col("c_id").alias("id"))).alias("best"), F.max("alone").alias("alone"))
    edges = stage(best.where("best.score > alone").select("v_id", F.col("best.id").alias("c_id")), "attached")
    while True:  # pointer jumping: chains halve each time
        up = edges.select(F.col("v_id").alias("c_id"), F.col("c_id").alias("up"))
        if edges.join(up, "c_id", "left_semi").isEmpty():
            break
        edges = stage(edges.join(up, "c_id", "left").select("v_id", F.coalesce("up", "c_id").alias("c_id")), "attached")
    return base.join(edges.withColumnRenamed("v_id", "label_id"), "label_id", "left").select("label_id", "series", F.coalesce("c_id", "label_id").alias("root_id"))


def same_names(attributed: DataFrame) -> DataFrame:
    """(label_id_1, label_id_2), smaller first, of the spellings with one root."""
    a = attributed.select("series", "root_id", F.col("label_id").alias("label_id_1"))
    b = attributed.select("series", "root_id", F.col("label_id").alias("label_id_2"))
    return a.join(b, ["series", "root_id"]).where("label_id_1 < label_id_2").select("label_id_1", "label_id_2")
