import base64
import random
from collections import Counter
from pathlib import Path

import pytest

from turnloom.llm import lookalikes, mojibake, packing, tokens, turns

TXT = "tbl string, row_id bigint, txt string, word string"


def found(spark, rows):
    df = spark.createDataFrame([("s", i, t, "clash") for i, t in rows], TXT)
    return sorted(r.row_id for r in lookalikes.find_lookalikes(df).collect())


def test_lookalikes_found(spark):
    cases = {1: "plain words", 2: "nb space", 3: "zero​width", 4: "ｆｕｌｌ width", 5: "café", 6: "sоme", 7: "спасибо", 8: "It’s — fine… “yes”", 9: "café Zoë", 10: "ﬁsh", 11: None, 12: "", 13: "а cat", 14: "smuɡ", 15: "ありがとう", 16: "🤷‍♂️ fine", 17: "a cat"}
    assert found(spark, list(cases.items()) + [(6, "sоme")]) == [2, 3, 4, 5, 6, 10, 13, 14]
    assert found(spark, []) == []


def test_dominant_script_decides():
    first = lambda word: [(b, k) for _, b, _, k in lookalikes.token_repairs(word)]
    assert first("роcа") == [("роса", 0), ("poca", 1)]  # three Cyrillic letters, one Latin
    assert first("сopa") == [("copa", 0), ("сора", 1)] and first("sоme") == [("some", 0)] and first("спасибo") == [("спасибо", 0)]
    assert first("plain") == first("спасибо") == first("") == []


def test_words_of_another_script_are_restored(spark):
    df = spark.createDataFrame([("s", 1, "холодная роса", "x"), ("s", 2, "роcа", "x"), ("s", 3, "а cope", "x"), ("s", 4, "cоре", "x"), ("s", 5, "роcа", "x"), (None, None, "роcа", "x")], TXT)
    out = {(r.tbl, r.row_id): (r.unified, r.n_repaired) for r in lookalikes.unify(df).collect()}
    assert out["s", 2] == out["s", 5] == out[None, None] == ("роса", 1) and out["s", 1] == ("холодная роса", 0) and out["s", 4] == ("cope", 1) and len(out) == 6
    assert sorted((r.tbl or "", r.row_id or 0) for r in lookalikes.find_lookalikes(df).collect()) == [("", 0), ("s", 2), ("s", 4), ("s", 5)]


def test_unified_forms_are_equal(spark):
    df = spark.createDataFrame([("s", 1, "some cat", "x"), ("s", 2, "sоme cat", "x"), ("s", 3, "ｓｏｍｅ c​at", "x"), ("s", 4, None, "x"), ("s", 5, "", "x"), ("s", 6, "qоzz", "x")], TXT)
    out = {r.row_id: r.unified for r in lookalikes.unify(df).collect()}
    assert out[1] == out[2] == out[3] == "some cat" and out[4] is None and out[5] == "" and out[6] == "qоzz"


GOOD = ["Élodie a caché la pâte brisée à l’hôtel.", "Größe und Übersetzung für fünf Tage, der Bäcker hört Märchen", "Łucja znalazła żółtą książkę w środę później", "Режиссёр спрятал ключ от подвала за театром", "Señor Íñigo escondió la canción extraña mañana"]


@pytest.mark.parametrize("text", GOOD)
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp1250", "cp437"])
def test_utf8_damage_is_undone(text, read):
    bad = "".join(mojibake._chars(read)[b] if b > 127 else chr(b) for b in text.encode())
    assert mojibake.garbled(bad)[0] == text
    twice = "".join(mojibake._chars("cp1252")[b] if b > 127 else chr(b) for b in bad.encode())
    assert mojibake.garbled(twice)[2]


def test_single_byte_damage_is_undone():
    for text, real, read in ((GOOD[3], "cp1251", "latin-1"), (GOOD[3], "koi8-r", "cp1251"), (GOOD[3], "cp866", "cp1251"), (GOOD[0].replace("’", "'"), "mac_roman", "cp1252"), (GOOD[2], "cp1250", "cp1252")):
        bad = "".join(mojibake._chars(read)[b] if b > 127 else chr(b) for b in text.encode(real))
        assert mojibake.garbled(bad)[0] == text


def test_right_texts_stay():
    for text in [*GOOD, "5ºB, 3½ stars™. £10, 20 €", "Ðóra’s Þ", "SÓ NA AÇÃO SEGUINTE — NÃO ANTES", "ÀÉÎ", "ありがとう 👍 ♪", "", "plain"]:
        assert mojibake.garbled(text) == (text, [], False)


def test_short_accented_words_stay():
    for text in ["été", "il a été là", "éwé", "Il a été élu à l'été"]:
        assert mojibake.garbled(text) == (text, [], False)


def test_layers_have_no_limit():
    text = bad = "La pâte brisée était cachée à l'hôtel"
    for _ in range(12):
        bad = "".join(mojibake._chars("cp1252")[b] if b > 127 else chr(b) for b in bad.encode())
    assert mojibake.garbled(bad)[0] == text


def test_cost_on_texts_of_another_source(spark):
    """Names of countries and languages as the JVM's own locale data has them: right texts stay, damaged ones are found."""
    locale = spark.sparkContext._jvm.java.util.Locale
    rng, right, wrong, tries, found_, restored = random.Random(1), 0, 0, 0, 0, 0
    for lang in "en fr de es pt pl ru".split():
        own = locale.forLanguageTag(lang)
        names = [locale.forLanguageTag("und-" + c).getDisplayCountry(own) for c in locale.getISOCountries()] + [locale.forLanguageTag(c).getDisplayLanguage(own) for c in locale.getISOLanguages()]
        rng.shuffle(names)
        for k in range(0, len(names), 6):
            text = ", ".join(names[k : k + 6])
            if text.isascii():
                continue
            right, wrong = right + 1, wrong + mojibake.garbled(text)[2]
            for read in ("cp1252", "latin-1", "mac_roman", "cp1250", "cp437"):
                new, _, hit = mojibake.garbled("".join(mojibake._chars(read)[b] if b > 127 else chr(b) for b in text.encode()))
                tries, found_, restored = tries + 1, found_ + hit, restored + (new == text)
    assert right > 300 and wrong <= 0.01 * right and found_ >= 0.99 * tries and restored >= 0.99 * tries


def test_garbled_rows(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (2, "café", "x"), (3, None, "x"), (4, "", "x"), (5, "souffl�", "x"), (1, "cafÃ©", "x")], "doc_id bigint, text string, restored string")
    out = sorted((r.doc_id, r.restored, r.complete) for r in mojibake.repair_garbled(df).collect())
    assert out == [(1, "café", True), (1, "café", True), (5, "souffl�", False)]


VOCABULARY = Path(tokens.TOKENIZERS) / "byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_ids_against_the_public_library():
    import tiktoken

    data = VOCABULARY.read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    public = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    bpe, rng = tokens.ByteBPE(data), random.Random(1)
    texts = [*GOOD, "a" * 3000, "ab" * 2000, " \n\t x  ", "<|endoftext|>", "".join(rng.choice("abcé ж\n") for _ in range(5000)), "we've I'LL"]
    for t in texts:
        assert bpe.encode(t) == public.encode_ordinary(t) and bpe.decode(bpe.encode(t)) == t


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_ids_of_missing_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "hi"), (3, "hi")], "doc_id bigint, text string")
    out = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode_corpus(df).collect())
    assert [x[0] for x in out] == [1, 2, 3, 3] and out[0][1] == out[1][1] == () and out[2][1]


def test_segment_tree_against_min():
    rng = random.Random(2)
    values = [rng.randrange(1000) for _ in range(37)]
    tree = tokens.SegmentTree(list(values))
    for _ in range(300):
        i = rng.randrange(37)
        values[i] = rng.randrange(1000)
        tree.put(i, values[i])
        assert tree.least() == min(values)


def test_containers(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([1, 3, 10, 40, 60, 99, 100, 101, 250])) for i in range(800)] + [(900, 0), (901, None), (902, 1000), (1, 7)]
    df = spark.createDataFrame([(a, b, "x") for a, b in sizes], "doc_id bigint, n_tokens bigint, piece string")
    out = packing.pack(df, 100).collect()
    fill, per_doc = Counter(), Counter()
    for r in out:
        fill[r.container_id] += r.n
        per_doc[r.doc_id] += r.n
    total = sum(b or 0 for _, b in sizes)
    assert max(fill.values()) <= 100 and sum(fill.values()) == total
    assert set(per_doc) == {a for a, _ in sizes} and per_doc[902] == 1000 and per_doc[1] == dict(sizes[:800])[1] + 7
    assert all(r.n == 100 or r.piece == 0 or r.start + r.n == dict(sizes)[r.doc_id] for r in out)
    assert len(fill) <= total / 100 * 1.03 + 2
    assert packing.pack(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("sizes", [[51] * 300, [60, 30, 11] * 100, [1] * 50 + [70] * 250, [0] * 300, list(range(1, 101)) * 3])
def test_handing_on_few_containers_loses_no_join(spark, sizes, monkeypatch):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint").repartition(3)
    few = packing.pack(df, 100, node_items=12).collect()
    monkeypatch.setattr(packing.heapq, "nsmallest", lambda n, x: sorted(x))  # hand on every underfull container
    every = packing.pack(df, 100, node_items=12).collect()
    count = lambda rows: len({r.container_id for r in rows if r.n})
    assert sorted(r.doc_id for r in few) == sorted(r.doc_id for r in every) == list(range(300))
    assert count(few) <= count(every) + 1
    assert max(Counter(r.container_id for r in few if not r.n).values(), default=0) <= 60  # size 0 piles up nowhere


def test_best_fit_never_overfills():
    rng = random.Random(6)
    sizes = [rng.randrange(0, 50) for _ in range(500)]
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for _, items in bins for i in items) == list(range(500))
    assert all(fill == sum(sizes[i] for i in items) <= 50 for fill, items in bins)
    assert sum(fill <= 25 for fill, _ in bins) <= 1


UTT = "utt_id bigint, episode string, idx int, speaker string, start_s double, end_s double, text string, turn string"
CAST = [("e", "SPEAKER_01", "Ann Lee"), ("e", "SPEAKER_02", "Bob Ray"), ("e", "SPEAKER_03", "Zoë Ray")]


def turn_rows(spark, rows, cast=CAST, partitions=3):
    df = spark.createDataFrame([(*r, "clash") for r in rows], UTT)
    c = spark.createDataFrame(cast, "episode string, raw_label string, canonical_name string")
    return sorted((r.first_utt_id, r.last_utt_id, r.speaker, r.text) for r in turns.speaker_turns(df, c, partitions).collect())


def test_turns(spark):
    rows = [
        (1, "e", 0, "SPEAKER_01", 1.0, 2.0, "[00:00:01] Um, hello- hello there"),
        (2, "e", 2, None, 3.0, None, "(laughter)"),
        (3, "e", 1, "?", 2.5, 3.0, "and again"),
        (3, "e", 1, "?", 2.5, 3.0, "and again"),
        (4, "e", 3, "SPEAKER_01", 4.0, 5.0, "BOB: Listen: no"),
        (5, "e", 4, "spk-2", 5.0, 6.0, "♪ slow piano ♪ yes"),
        (6, "e", 5, "[zoe]", 6.0, 7.0, "Right."),
        (7, "e", 6, "Zoë Ray (V.O.)", 7.0, 8.0, None),
        (8, "e", 7, "SPEAKER_03", 8.0, 9.0, "Uh-huh... um"),
        (9, None, 8, "SPEAKER_03", 8.0, 9.0, "lost"),
    ]
    want = [(1, 3, "Ann Lee", "hello there and again"), (4, 5, "Bob Ray", "Listen: no yes"), (6, 6, "Zoë Ray", "Right.")]
    for n in (1, 2, 5):
        assert turn_rows(spark, rows, partitions=n) == want
    assert turn_rows(spark, []) == []


def test_turns_over_partitions_equal_one_partition(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["e", "f"]), i, rng.choice(["SPEAKER_01", "SPEAKER_02", None, None, "x"]), float(i), i + 0.5, rng.choice(["word", "(sighs)", "Ann: hi", "um"])) for i in range(400)]
    one = turn_rows(spark, rows, partitions=1)
    assert turn_rows(spark, rows, partitions=9) == turn_rows(spark, rows, partitions=50) == one


def test_labels_before_a_dash(spark):
    rows = [
        (1, "e", 0, "SPEAKER_01", 1.0, 2.0, "One"),
        (2, "e", 1, "UNKNOWN", 2.0, 3.0, "Bob Ray - Let's go"),
        (3, "e", 2, None, 3.0, 4.0, "[111m20s] Ann Lee – Listen: no"),
        (4, "e", 3, "?", 4.0, 5.0, "00:32:50:20 Bob Ray - [32m50s] Can you"),
        (5, "e", 4, " ", 5.0, 6.0, "(3:49:06) Zoë Ray - My 03:49:06:06 cousin"),
        (6, "e", 5, None, 6.0, 7.0, "Nobody here - we said"),
        (7, "e", 6, None, 7.0, 8.0, "SPEAKER_01 — yes - no"),
        (8, "e", 7, "SPEAKER_02", 8.0, 9.0, "Ann- Ann - Lee: hello"),
        (9, "e", 8, "SPEAKER_02", 9.0, 10.0, "Zoë- wait"),
        (10, "e", 9, None, 10.0, 11.0, "Ann - Lee: hello"),
    ]
    want = [
        (1, 1, "Ann Lee", "One"),
        (2, 2, "Bob Ray", "Let's go"),
        (3, 3, "Ann Lee", "Listen: no"),
        (4, 4, "Bob Ray", "Can you"),
        (5, 6, "Zoë Ray", "My cousin Nobody here - we said"),
        (7, 7, "Ann Lee", "yes - no"),
        (8, 9, "Bob Ray", "Ann - Lee: hello Zoë- wait"),
        (10, 10, "Ann Lee", "hello"),
    ]
    for n in (1, 3):
        assert turn_rows(spark, rows, partitions=n) == want
