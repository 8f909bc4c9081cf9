import random
from itertools import combinations

from turnloom.llm import linkage, names

LAB = "label_id bigint, series string, label string, root_id string"


def pairs(spark, groups, uses=()):
    rows, want, k = [], set(), 0
    for series, group in groups:
        ids = []
        for label in group:
            k += 1
            ids.append(k)
            rows.append((k, series, label, "clash"))
        want |= set(combinations(ids, 2))
    df = spark.createDataFrame(rows + rows[:2], LAB)
    u = spark.createDataFrame(list(uses) or [("s", None)], "series string, label string")
    got = {(r.label_id_1, r.label_id_2) for r in names.same_names(names.attribute(df, u)).collect()}
    return got, want


def test_spellings_of_one_person(spark):
    groups = [
        ("s", ["Josephine Sablsson", "Josephine Salbsson", "Sablsson, Josephiine", "JOSEPHINE SABLSSON", 'Josephine "Jo" Sablsson', "J. Sablsson", "Josie Sablsson"]),
        ("s", ["Edward Bramanby", "Ned Bramanby", "Bramanby, Edward"]),
        ("s", ["Oskar Bramanby", "Bramanby Oskar"]),
        ("s", ["Redbrick Municipal Savings Corporation", "RMSC (Redbrick)", "Redbrick Savings Corporation", "The Redbrick Municipal Savings Corp.", "Savings Corporation, Redbrick Municipal"]),
        ("s", ["Redbrick Municipal Police Department"]),
        ("t", ["Edward Bramanby", "Edward B."]),
        ("t", [None]),
        ("t", ["???"]),
    ]
    got, want = pairs(spark, groups)
    label = {i: x for i, x in enumerate((x for _, g in groups for x in g), 1)}
    assert {(label[a], label[b]) for a, b in got ^ want} == set()


def test_empty_labels(spark):
    df = spark.createDataFrame([], LAB)
    u = spark.createDataFrame([], "series string, label string")
    assert names.attribute(df, u).count() == 0


def test_edits_and_nicknames():
    assert names.edits("sablsson", "salbsson") == 1 and names.edits("abc", "abc") == 0 and names.edits("kitten", "sitting") == 3
    assert names.is_nickname("becca", "rebecca") and names.is_nickname("debbie", "deborah") and not names.is_nickname("anna", "bob")
    assert names.parse("") is None and names.parse("...") is None


SEN = "sent_id bigint, episode string, sentence_id int, scene_id int, speaker string, utterance string, alignment_score double, root string"
DIA = "dialogue_id bigint, episode_root string, dialogue_idx int, scene_idx int, speaker_ct string, utterance_ct string, root string"
NOUN = "lantern kettle ferret anchor banjo cactus hammock iguana jukebox locket mattress napkin oven parrot quilt radiator saxophone teapot ukulele violin".split()
VERB = "borrowed cancelled dropped hid inspected juggled measured painted repaired sold traded varnished".split()


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    s, d, want, line, sid = [], [], set(), 0, 0
    for i in range(n):
        scene, line = 1 + i // 15, line + 1
        who = rng.choice(["Ann Lee", "Bob Ray", "Cy Poe"])
        parts = [f"my cousin {rng.choice(VERB)} the {rng.choice(NOUN)} near the {rng.choice(NOUN)}" for _ in range(rng.choice([1, 1, 2, 3]))]
        kept = rng.random() > 0.08
        if kept:
            d.append((line, "x_s01e01", line, scene if rng.random() > 0.05 else None, who, ". ".join(p.capitalize() for p in parts) + ".", "c"))
        for p in parts:
            sid += 1
            words = p.split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "um"
            s.append((sid, "x_s01e01a", sid, scene if rng.random() > 0.05 else None, who if rng.random() > 0.3 else None, " ".join(words), 0.8, "c"))
            if kept:
                want.add((line, sid))
    return s, d, want


def link(spark, s, d):
    return linkage.link_records(spark.createDataFrame(s, SEN), spark.createDataFrame(d, DIA)).collect()


def test_links_of_a_made_up_episode(spark):
    s, d, want = corpus()
    out = link(spark, s + s[:10], d + d[:5])
    got = {(r.dialogue_id, r.sent_id) for r in out}
    assert len(got) == len(out) == len({g[1] for g in got})
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert all(0 <= r.confidence <= 1 for r in out)


def test_links_of_missing_values(spark):
    s = [(1, "x_s01e01a", 1, 1, None, None, None, "c"), (2, None, 2, 1, "a", "hello kettle", 0.5, "c"), (None, "x_s01e01a", 3, 1, "a", "hello kettle", 0.5, "c"), (4, "x_s01e01a", 4, None, "a", "", float("nan"), "c"), (5, "odd", 5, None, "a", "the very long kettle song", None, "c")]
    d = [(1, "x_s01e01", 1, 1, None, None, "c"), (2, "x_s01e01", None, 1, "a", "hello kettle", "c"), (3, None, 3, None, "a", "", "c"), (4, "odd", 1, None, "a", "The very long kettle song.", "c")]
    assert {(r.dialogue_id, r.sent_id) for r in link(spark, s, d)} <= {(4, 5)}
    assert link(spark, [], d) == [] and link(spark, s, []) == []


def test_decoding_keeps_the_order():
    rows = [{"pos": p, "line": n, "begin": 0, "finish": 4, "confidence": c, "sent_id": p, "dialogue_id": n} for p, n, c in ((1, 1, 0.9), (2, 9, 0.9), (2, 2, 0.85), (3, 3, 0.9), (4, 4, 0.9))]
    assert [r["line"] for r in linkage.decode(rows)] == [1, 2, 3, 4]


def test_fit_separates_levels():
    counts = [((5, 2, 0, 3), 500.0), ((5, 2, 1, 3), 60.0), ((1, 1, 3, 2), 900.0), ((0, 1, 4, 2), 400.0), ((3, 2, 0, 3), 80.0)]
    prior, m, u = linkage.fit(counts)
    assert 0.2 < prior < 0.6 and m[0][5] > u[0][5] and m[1][2] > u[1][2] and u[2][4] > m[2][4]


PEOPLE = "label_id bigint, series string, label string, level int, given string, surname string, quoted string"


def test_nicknames_are_learnt(spark):
    rows = []
    for k in range(6):  # Zork goes with Zebulon wherever either is, Ann only by chance
        rows += [(f"s{k}", "zebulon", f"fam{k}"), (f"s{k}", "zork", f"fam{k}")]
        rows.append((f"s{k}", "ann", f"fam{k}" if k == 0 else f"other{k}"))
    df = spark.createDataFrame([(i, s, g, 3, g, f, None) for i, (s, g, f) in enumerate(rows)] + [(90, "s1", "x", 3, "quentin", "lee", "quippy")], PEOPLE)
    assert {(r.a, r.b) for r in names.learnt_nicknames(df).collect()} == {("zebulon", "zork"), ("zork", "zebulon"), ("quentin", "quippy"), ("quippy", "quentin")}
    assert names.learnt_nicknames(df.limit(0)).count() == 0


def test_likelihoods_are_estimated(spark):
    schema = "v_id bigint, c_id bigint, prior double, ops array<double>, alone double"
    typo, nick = [1.0] + [0.0] * 6, [0.0, 0.0, 1.0] + [0.0] * 4
    df = spark.createDataFrame([(i, 10_000 + i, -1.0, typo if i % 10 else nick, -12.0) for i in range(4000)], schema)
    theta = dict(zip(names.OPS, names.estimated(df, 8000)))
    assert theta["typo"] > names.PRIOR[0] and theta["nick"] < names.PRIOR[2] and theta["typo"] > theta["nick"]
    assert names.estimated(df.limit(0), 0) == [__import__("pytest").approx(p) for p in names.PRIOR]


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(i, "s", x, "c") for i, x in enumerate(["Edward Bramanby", "Ned Bramanby", "E. Bramanby", "Bramanby, Edwrad", "Joan Lee", "Joan Leee", "Lee, Joan", None, "??"] * 3)]
    df, u = spark.createDataFrame(rows, LAB), spark.createDataFrame([("s", "Edward Bramanby")] * 5, "series string, label string")
    whole = sorted(map(tuple, names.attribute(df, u).collect()))
    monkeypatch.setattr(names, "BLOCK", 3)
    assert sorted(map(tuple, names.attribute(df, u).collect())) == whole and len(whole) == 27


def test_blocking_reaches_wrong_and_missing_scenes(spark):
    s, d, want = corpus(3, 260)
    rng = random.Random(9)
    s = [(*r[:3], rng.choice([r[3], r[3], r[3], None, 1, 17]), *r[4:]) for r in s]
    pairs = {(r.dialogue_id, r.sent_id) for r in linkage.candidate_pairs(spark.createDataFrame(s, SEN), spark.createDataFrame(d, DIA)).collect()}
    assert len(pairs & want) >= 0.98 * len(want)  # with half of the scenes wrong or missing
    bare = [(*r[:3], None, *r[4:]) for r in s]  # no scene at all: places in proportion, and word triples
    pairs = linkage.candidate_pairs(spark.createDataFrame(bare, SEN), spark.createDataFrame(d, DIA)).collect()
    assert len({(r.dialogue_id, r.sent_id) for r in pairs} & want) >= 0.95 * len(want)
    assert len({(r.dialogue_id, r.sent_id) for r in pairs}) == len(pairs)  # a pair of several passes counts once


def test_stock_phrases_meet_near_their_place(spark, monkeypatch):
    monkeypatch.setattr(linkage, "STOCK", 3)
    monkeypatch.setattr(linkage, "STOCK_BLOCK", 8)
    s, d, want = corpus(4, 200)
    pairs = {(r.dialogue_id, r.sent_id) for r in linkage.candidate_pairs(spark.createDataFrame(s, SEN), spark.createDataFrame(d, DIA)).collect()}
    assert len(pairs & want) >= 0.97 * len(want)


def test_decoding_joins_a_line_at_any_distance():
    row = lambda pos, line, begin, finish, c: {"pos": pos, "line": line, "begin": begin, "finish": finish, "confidence": c, "sent_id": pos, "dialogue_id": line}
    # 60 weak candidates of other lines stand between the two halves of line 5.
    rows = [row(1, 5, 0, 4, 0.95), *[row(2, 100 + k, 0, 2, 0.03) for k in range(60)], row(3, 5, 4, 8, 0.95)]
    assert [(r["pos"], r["line"]) for r in linkage.decode(rows)] == [(1, 5), (3, 5)]


def best_total(rows):
    """The greatest total over all order-preserving choices, by trying every state before."""
    import math

    rows = sorted(rows, key=lambda r: (r["pos"], r["line"], r["begin"]))
    totals = []
    for i, r in enumerate(rows):
        best = 0.0
        for j, q in enumerate(rows[:i]):
            step, gone = r["line"] - q["line"], r["pos"] - q["pos"]
            if gone <= 0 or step < 0:
                continue
            if step == 0:
                free = q["finish"] <= r["begin"] + 1
                if not free and not (q["begin"] < r["begin"] and q["finish"] < r["finish"]):
                    continue
                price = 0.0 if free else linkage.SKIP
            else:
                price = 0.0 if step == 1 else min(linkage.LEAP, linkage.SKIP + linkage.STEP * max(0, step - gone))
            best = max(best, totals[j] - price)
        totals.append(best + math.log(r["confidence"] / (1 - r["confidence"])) + 1.0 if best + math.log(r["confidence"] / (1 - r["confidence"])) + 1.0 > 0 else -1e9)
    return max(totals, default=0.0), rows, totals


def test_decoding_against_every_choice():
    import math

    rng = random.Random(12)
    for _ in range(300):
        rows = []
        for pos in range(rng.randrange(1, 14)):
            for line in rng.sample(range(12), rng.randrange(0, 4)):
                begin = rng.randrange(8)
                rows.append({"pos": pos, "line": line, "begin": begin, "finish": begin + rng.randrange(1, 5), "confidence": rng.choice([0.1, 0.4, 0.8, 0.95]), "sent_id": pos, "dialogue_id": line})
        want, _, _ = best_total(rows)
        chosen, total = linkage.decode(rows), 0.0
        for k, r in enumerate(chosen):
            price = 0.0
            if k:
                q = chosen[k - 1]
                step, gone = r["line"] - q["line"], r["pos"] - q["pos"]
                price = (0.0 if q["finish"] <= r["begin"] + 1 else linkage.SKIP) if step == 0 else 0.0 if step == 1 else min(linkage.LEAP, linkage.SKIP + linkage.STEP * max(0, step - gone))
            total += math.log(r["confidence"] / (1 - r["confidence"])) + 1.0 - price
        assert abs(total - max(want, 0.0)) < 1e-9


def test_one_shared_triple_is_enough_anywhere(spark, monkeypatch):
    """However many lines share it: those of a stock phrase are dealt out in blocks, none is left out."""
    monkeypatch.setattr(linkage, "STOCK", 30)
    monkeypatch.setattr(linkage, "STOCK_BLOCK", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfgklmnprst", k=7))
    typed = [f"never ever again {word()}" if i >= 150 and i % 3 == 0 else f"by the riverside {word()}" if i >= 150 and i % 25 == 1 else f"{word()} {word()}" for i in range(480)]
    said = ["never ever again" if i == 10 else "by the riverside" if i == 20 else word() for i in range(480)]
    d = [(i, "x_s01e01", i, 1 + i // 120, None, text, None) for i, text in enumerate(typed)]
    s = [(i, "x_s01e01a", i, 1 + i // 120, None, text, None, None) for i, text in enumerate(said)]
    pairs = {(r.sent_id, r.dialogue_id) for r in linkage.candidate_pairs(spark.createDataFrame(s, SEN), spark.createDataFrame(d, DIA)).collect()}
    want = {(10 if text.startswith("never") else 20, i) for i, text in enumerate(typed) if len(text.split()) == 4}
    assert pairs >= want and len(want) == 120


def test_last_pass_sends_blocks_and_finds_every_pair(spark, monkeypatch):
    """Texts cross the network once for each block, not once for each pair, and pairs and levels are those of every sentence
    with every line."""
    monkeypatch.setattr(linkage, "STOCK", 16)
    monkeypatch.setattr(linkage, "STOCK_BLOCK", 32)
    rng = random.Random(3)
    words = "my cousin never ever dropped lantern lanterns kettle ketle the of by night 2 nights repaired repaird um".split()
    text = lambda: " ".join([rng.choice(["my cousin never", "by the night", ""]), *rng.choices(words, k=rng.randrange(1, 7))]).strip()
    sentences = [{"sent_id": i, "pos": i, "words": text(), "names": rng.choice(["", "ann lee"]), "score": rng.choice([None, 0.6, 0.8]), "places": rng.choice([[], [i * 1.0], [i / 2, 90.0]])} for i in range(60)]
    lines = [{"line": i, "dialogue_id": 500 + i, "words": text(), "names": rng.choice(["", "ann lee", "bob ray"])} for i in range(120)]
    got = sorted(linkage.share_triples("x", sentences, lines))
    want = []
    for s in sentences:
        _, probe, need = linkage.stems(s["words"])
        for d in lines:
            alike = linkage.triples(s["words"].split()) & linkage.triples(d["words"].split()) and len(set(probe) & set(linkage.stems(d["words"])[0])) >= need
            if alike and all(abs(d["line"] - p) > linkage.WINDOW for p in s["places"]):
                want.append(linkage._levels(s["sent_id"], d["dialogue_id"], "x", s["pos"], d["line"], s["words"], d["words"], s["names"], d["names"], s["places"], s["score"]))
    assert got == sorted(want) and len(got) > 100
    s = [(r["sent_id"], "x_s01e01a", r["pos"], None, None, r["words"], None, None) for r in sentences]
    d = [(r["dialogue_id"], "x_s01e01", r["line"], None, None, r["words"], None) for r in lines]
    pairs = linkage.candidate_pairs(spark.createDataFrame(s, SEN), spark.createDataFrame(d, DIA))
    assert "Aggregate [sent_id" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == pairs.select("sent_id", "dialogue_id").distinct().count() > 0
