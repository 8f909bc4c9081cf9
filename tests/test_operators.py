import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.functions import similarity as S
from turnloom.functions import text as T
from turnloom.operators import align, impute, metrics, network, qa, sequence

ROW = "episode string, scene_id int, sentence_id int, start_s double, end_s double, speaker string, source string"


def turns_of(spark, speakers, scene=1, episode="e"):
    rows = [(episode, scene, i, float(i), i + 0.5, s, "clash") for i, s in enumerate(speakers)]
    return network.turns(spark.createDataFrame(rows, ROW), ["sentence_id"])


def test_adjacency_and_proximity(spark):
    assert [r.adjacency for r in network.adjacency_counts(turns_of(spark, "ABAB")).collect()] == [3]
    assert network.adjacency_counts(turns_of(spark, "AAA")).count() == 0
    near = {(r.source, r.target): r.proximity for r in network.proximity_scores(turns_of(spark, "ABC"), 2).collect()}
    assert near[("A", "B")] > near[("A", "C")]


def test_turns_leave_out_what_has_no_place(spark):
    nan = float("nan")
    rows = [("e", 1, 1, 0.0, None, " A ", "x"), ("e", None, 2, 1.0, 2.0, "B", "x"), ("e", 1, 3, None, 2.0, "B", "x"), ("e", 1, 4, nan, 2.0, "B", "x"), ("e", 1, 5, 3.0, 4.0, " ", "x"), (None, 1, 6, 3.0, 4.0, "B", "x"), ("e", 1, 7, 3.0, nan, "C", "x")]
    out = network.turns(spark.createDataFrame(rows, ROW), ["sentence_id"]).orderBy("pos").collect()
    assert [(r.speaker, r.pos, r.end_s) for r in out] == [("A", 1, 0.0), ("C", 2, 3.0)]


def test_scene_and_episode_edges(spark):
    t = turns_of(spark, "AB").unionByName(turns_of(spark, "ABA", 2))
    e = network.scene_edges(t)
    assert {r.scene_id: (r.weight, r.adjacency) for r in e.collect()} == {1: (1.75, 1.0), 2: (3.25, 2.0)}
    assert [(r.weight, r.adjacency) for r in network.episode_edges(e).collect()] == [(5.0, 3.0)]
    assert network.scene_edges(turns_of(spark, "")).count() == 0
    graphs = network.scene_graphs(turns_of(spark, "A"), network.scene_edges(turns_of(spark, "A"))).collect()
    assert graphs[0].nodes == ["A"] and graphs[0].edges == []


def test_episode_edges_of_turns_match_the_scenes_edges(spark):
    rng = random.Random(5)
    rows = []
    for e, scenes, cast, n in (("d1", range(24), 30, 300), ("d2", (0, 31), 7, 80), ("d3", range(12), 9, 120)):
        rows += [(e, rng.choice(scenes), 1000 + i, float(i), i + 0.5, f"u{rng.randrange(cast)}", "x") for i in range(n)]
    few = network.turns(spark.createDataFrame(rows, ROW), ["sentence_id"])
    wide = [("d4", rng.choice([-40, -1, 0, 31, 32, 63, 64, 1000]), i, float(i), i + 0.5, rng.choice("ABCDEÄz"), "x") for i in range(60)]
    many = few.unionByName(network.turns(spark.createDataFrame(wide, ROW), ["sentence_id"]))
    crowd = [("d5", 3 + i // 300, i, float(i), i + 0.5, f"u{i % 290}", "x") for i in range(320)]  # more speakers than a list of targets holds
    kinds = [(few.unionByName(network.turns(spark.createDataFrame(crowd, ROW), ["sentence_id"])), {"scenes": 32}, {}), (many, {}, {}), (many, {}, {"window": 2, "adjacency": -1.0, "proximity": 0.3, "copresence": 0.1}), (few, {"scenes": 32}, {"copresence": 0.0})]
    for t, bound, how in kinds:
        got = network.episode_edges_of(t, **bound, **how)
        want = network.episode_edges(network.scene_edges(t, **how))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="not a scene below 32"):
        network.episode_edges_of(many, scenes=32).collect()
    with pytest.raises(ValueError):
        network.episode_edges_of(few, scenes=33)


def test_event_edges_shuffle_no_pairs(spark, tmp_path):
    spark.sql("select id as event_id, timestamp_millis(id * 61000) as ts, id * 7 % 30 as user_id from range(3000)").write.parquet(str(tmp_path / "events.parquet"))
    from turnloom.plans import catalogue

    out = catalogue.QUERIES["event_edges"](spark, str(tmp_path))
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate inline")
    assert len(above) == 2 and "Exchange" not in above[0].split("Join")[0] and "Aggregate" not in above[0]
    want = network.episode_edges(network.scene_edges(network.turns_of_events(spark.read.parquet(str(tmp_path / "events.parquet")))))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_centralities(spark):
    e = spark.createDataFrame([("e", 1, "A", "B", 4.0), ("e", 1, "A", "C", 1.0), ("e", 1, "B", "C", 1.0)], "episode string, scene_id int, source string, target string, weight double")
    n = spark.createDataFrame([("e", 1, c) for c in "ABC"] + [("e", 2, "Z")], "episode string, scene_id int, character string")
    share = {(r.scene_id, r.character): r.value for r in metrics.strength_share(n, e, ["episode", "scene_id"]).collect()}
    assert abs(sum(v for (s, _), v in share.items() if s == 1) - 1) < 1e-9 and share[1, "A"] == share[1, "B"] > share[1, "C"] and share[2, "Z"] == 0
    degree = {(r.scene_id, r.character): r.value for r in metrics.degree_unweighted(n, e, ["episode", "scene_id"]).collect()}
    assert degree[1, "A"] == 1.0 and degree[2, "Z"] == 0.0
    line = {"A": {"B": 5.0}, "B": {"A": 5.0, "C": 5.0}, "C": {"B": 5.0}}
    assert metrics.betweenness_of(line) == {"A": 0.0, "B": 1.0, "C": 0.0}
    vector = metrics.eigenvector_of(line)
    assert abs(vector["B"] - 2**-0.5) < 1e-3 and abs(vector["A"] - 0.5) < 1e-3
    with pytest.raises(ValueError):
        metrics.centrality(n, e, ["episode"], "fame")


def test_communities():
    graph = metrics._graph(list("abcdef"), [("a", "b", 3), ("b", "c", 3), ("a", "c", 3), ("d", "e", 3), ("e", "f", 3), ("d", "f", 3), ("c", "d", 0.5)])
    for found in (metrics.louvain_of(graph), metrics.girvan_newman_of(graph)):
        assert found == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}
    assert metrics.modularity(graph, metrics.louvain_of(graph)) > 0.3
    assert metrics.components_of(metrics._graph(["x", "y", "z"], [("x", "y", 1.0)])) == {"x": "x", "y": "x", "z": "z"}
    assert metrics.louvain_of({}) == {} and metrics.girvan_newman_of({"a": {}}) == {"a": 0}


def test_word_sessions(spark):
    schema = "episode string, idx int, word string, start_s double, end_s double, speaker string"
    df = spark.createDataFrame([("e", 0, "hi", 0.0, 0.2, "a"), ("e", 1, "you", 0.25, 0.5, "a"), ("e", 2, "so", 1.2, 1.3, "a"), ("e", 3, "no", 1.35, 1.5, "b"), ("e", 4, None, 1.6, None, None)], schema)
    out = sequence.word_sessionization(df, ["episode"], "idx").orderBy("idx").collect()
    assert [(r.text, r.speaker, r.n_words) for r in out] == [("hi you", "a", 2), ("so", "a", 1), ("no", "b", 1), ("", None, 1)]
    with pytest.raises(ValueError):
        sequence.word_sessionization(df, ["episode"], "idx", -1)
    assert sequence.word_sessionization(df.limit(0), ["episode"], "idx").count() == 0


def test_blocked_fills_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 5)
    rng = random.Random(1)
    rows = [(e, i, rng.choice([None, None, i])) for e in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "episode string, i int, scene_id int")
    want, last = {}, {}
    for e, i, s in rows:
        last[e] = s if s is not None else last.get(e, 1)
        want[e, i] = last[e]
    assert {(r.episode, r.i): r.scene_id for r in sequence.fill_scene_ids(df, ["episode"], "i").collect()} == want
    back = sequence.running_last(df, ["episode"], "i", F.col("scene_id"), "n", inclusive=False, forward=False)
    for r in back.collect():
        assert r.n == next((s for e, i, s in rows if e == r.episode and i > r.i and s is not None), None)
    total = sequence.running_sum(df, ["episode"], "i", F.lit(1), "n")
    assert all(r.n == r.i + 1 for r in total.collect())


def test_markers(spark):
    df = spark.createDataFrame([("a", i, k) for i, k in enumerate(["d", "s", "d", "s", "d"])] + [("b", 0, "d")], "k string, i int, kind string")
    out = {(r.k, r.i): r.scene_id for r in sequence.scene_ids_from_markers(df, ["k"], "i", F.col("kind") == "s").collect()}
    assert out == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 2, ("b", 0): None}


def test_end_times(spark):
    df = spark.createDataFrame([("e", 1, 0.0, 0.0), ("e", 2, 2.0, None), ("f", 1, 5.0, 4.0)], "episode string, idx int, start_s double, end_s double")
    assert [r.end_s for r in sequence.estimate_end_times(df, ["episode"], ["idx"]).orderBy("episode", "idx").collect()] == [2.0, 2.5, 5.5]


def test_shots_of_times(spark):
    shots = spark.createDataFrame([("e", 1, 0.0, 5.0), ("e", 2, 5.0, 200.0), ("e", 3, None, 9.0)], "episode string, shot_id int, start_s double, end_s double")
    times = spark.createDataFrame([(1, "e", 0.0), (2, "e", 5.0), (3, "e", 200.0), (4, "e", 201.0), (5, "f", 1.0), (6, "e", None), (7, "e", 130.0)], "i int, episode string, t double")
    got = {r.i: r.shot_id for r in sequence.shot_at(times, shots, "episode", "t", "i").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: None, 5: None, 6: None, 7: 2}
    last = {r.i: r.shot_id for r in sequence.asof_shot(times, shots, "episode", "t", "i").collect()}
    assert last == {1: 1, 2: 2, 3: 2, 4: 2, 5: None, 7: 2}


def pointer(words, sentences):
    """The mapping of words to sentences, one word after another."""
    out, at = [], 0
    for a, b in words:
        while at + 1 < len(sentences) and a > sentences[at][1] + 1e-3:
            at += 1
        best, top = None, -1.0
        for k in (at, at - 1, at + 1):
            if 0 <= k < len(sentences):
                s, e = sentences[k]
                if s - 1e-3 <= a <= e + 1e-3:
                    best = k
                    break
                if min(b, e) - max(a, s) > top:
                    best, top = k, min(b, e) - max(a, s)
        out.append(best)
    return out


def test_words_to_sentences_against_a_loop(spark):
    rng = random.Random(4)
    ws, ss, want = [], [], {}
    for e in range(25):
        starts = sorted(rng.uniform(0, 20) for _ in range(rng.randint(1, 6)))
        sen = [(a, a + rng.uniform(0, 4)) for a in starts]
        wor = [(a, a + rng.uniform(0, 1)) for a in (rng.uniform(0, 22) for _ in range(12))]
        ss += [(str(e), i, *x) for i, x in enumerate(sen)]
        ws += [(str(e), i, *x) for i, x in enumerate(wor)]
        want |= {(str(e), i): k for i, k in enumerate(pointer(wor, sen))}
    schema = "episode string, idx int, start_s double, end_s double"
    got = sequence.words_to_sentences(spark.createDataFrame(ws, schema), spark.createDataFrame(ss, schema), ["episode"])
    assert {(r.episode, r.idx): r.sentence_idx for r in got.collect()} == want


def test_sliding_window(spark):
    sim = spark.createDataFrame([("e", i, j, 1.0 if j in (3, 4) else 0.0) for i in range(2) for j in range(6)], "e string, i int, j int, sim double")
    n = spark.createDataFrame([("e", 6)], "e string, n int")
    r = sequence.sliding_window_best(sim, ["e"], "i", "j", "sim", 2, n).collect()[0]
    assert (r.start_idx, r.end_idx, r.score) == (2, 4, 1.0)
    with pytest.raises(ValueError):
        sequence.sliding_window_best(sim, ["e"], "i", "j", "sim", 0, n)


FILL = "sent_id int, episode string, scene_id int, sentence_id int, utterance string, speaker string, speaker_ct string"


def test_cascade_against_the_fold(spark):
    """The closed form, and the folds it falls back to, over random files: what a fold over whole files gives."""
    rng = random.Random(11)
    texts = ["yes", "and then we all went home again", "ann please do sit down now", "this is a rather long line", "bob and ann", "no way there", "theme song", "[door]", "", "well maybe so it is", "oh"]
    rows = []
    for e in range(60):
        scene = 1
        for i in range(rng.randint(3, 14)):
            if rng.random() < 0.25:
                scene = rng.choice([scene + 1, max(1, scene - 1)]) if e % 3 == 0 else scene + 1
            rows.append((len(rows), f"e{e}", None if rng.random() < 0.08 else scene, i, rng.choice(texts), rng.choice(["Ann", "Bob", "Cy", "", "", None]), ""))
    base = impute.direct_fill(spark.createDataFrame(rows, FILL))
    got = {r.sent_id: (r.speaker, r.speaker_method, r.speaker_confidence, r.alignment_score, r.review_flag, r.review_reason, r.notes) for r in impute.cascade(base, ["episode"], "sentence_id").collect()}
    pdf = base.withColumns({"wc": T.word_count(F.col("utterance")), "norm": T.normalize_rule(F.col("utterance"))}).toPandas()
    for _, g in pdf.groupby("episode"):
        for r in impute.fold_rows(g.sort_values("sentence_id")).itertuples():
            assert got[r.sent_id] == (r.speaker, *(impute.outcome(r.fill_rule, impute.Rules().scores) if r.fill_rule else ("", "", 0.0, False, "", ""))), r


def test_direct_fill_and_review(spark):
    rows = [(1, "e", 1, 1, "hello", "", "Ann"), (2, "e", 1, 2, "hi", "Bob", "Bob"), (3, "e", 1, 3, "(door)", None, None), (4, "e", 1, 4, "so", " ", None), (5, "e", 1, 5, None, "Cy", "Ann")]
    out = {r.sent_id: r for r in impute.stamp_review(impute.direct_fill(spark.createDataFrame(rows, FILL))).collect()}
    assert [out[i].speaker for i in range(1, 6)] == ["Ann", "Bob", "", "", "Cy"]
    assert [out[i].speaker_method for i in range(1, 6)] == ["community_transcript_match"] * 2 + ["direction", "unresolved", ""]
    assert [out[i].review_flag for i in range(1, 6)] == [False, False, False, True, False]


QA = "sent_id int, episode string, scene_id int, sentence_id int, utterance string, speaker string, speaker_ct string, speaker_confidence string, speaker_method string, alignment_score double, review_flag boolean, review_reason string, notes string"


def qa_rows(speakers, ct=None, conf="low"):
    return [(i, "e", 1, i, "yes", s, (ct or {}).get(i, ""), conf, "x", 0.5, True, "r", "") for i, s in enumerate(speakers)]


def test_bridge_sees_earlier_changes(spark):
    out = qa.scene_corrections(spark.createDataFrame(qa_rows("ABABA"), QA), ["episode"], "sentence_id", anomaly=False)
    assert {r.sent_id: r.new_speaker for r in out.where("fix <> ''").collect()} == {1: "A", 3: "A"}


def test_quality_stages(spark):
    df = spark.createDataFrame(qa_rows(["A", "B", "A", "C"], {3: "D"}), QA)
    rows, logs = qa.run_all(df, ["episode"], "sentence_id")
    out = {r.sent_id: r for r in rows.collect()}
    assert [out[i].speaker for i in range(4)] == ["A", "A", "A", "D"] and not out[3].review_flag
    assert out[1].notes == "QA correction: surrounded by same speaker within scene" and out[1].speaker_method == "qa_scene_bridge_override" and sum(x.count() for x in logs) == 2
    assert qa.run_all(df.limit(0), ["episode"], "sentence_id")[0].count() == 0


def test_quality_summary(spark):
    df = spark.createDataFrame(qa_rows(["A", "B", "A", "C", ""], {3: "D"}), QA)
    rows, (one, two) = qa.run_all(df, ["episode"], "sentence_id")
    files = qa.summary(df, rows, one.unionByName(two), ["episode"])
    r = files.collect()[0]
    assert (r.rows, r.review_rows_before_qa, r.speaker_ct_overrides, r.scene_bridge_fixes, r.scene_anomaly_fixes, r.remaining_unresolved_rows) == (5, 5, 1, 1, 0, 1)
    whole = qa.summary_rollup(files).collect()[0]
    assert whole.files_processed == 1 and whole.total_rows == 5 and qa.summary_rollup(files.limit(0)).collect()[0].total_rows == 0


def test_unsupported_speaker_takes_its_own_reason(spark):
    rows = [(0, "e", 1, 0, "a b c d e f", "A", "A", "high", "x", 1.0, False, "", ""), (1, "e", 1, 1, "a b c d e f", "B", "C", "low", "x", 0.5, True, "", ""), (2, "e", 1, 2, "a b c d e f", "A", "A", "high", "x", 1.0, False, "", "")]
    df = spark.createDataFrame(rows + [(9, "e", None, 9, "yes", "Z", "", "low", "x", 0.1, True, "", "")], QA)
    out = {r.sent_id: (r.new_speaker, r.fix, r.qa_reason) for r in qa.scene_corrections(df, ["episode"], "sentence_id").collect()}
    assert out[9] == (None, "", None) and out[0] == (None, "", None)
    assert out[1] == ("A", "unsupported", qa.CORRECTIONS["unsupported"][1])
    rows[1] = (*rows[1][:6], "", *rows[1][7:])
    out = {r.sent_id: (r.new_speaker, r.fix) for r in qa.scene_corrections(spark.createDataFrame(rows, QA), ["episode"], "sentence_id").collect()}
    assert out[1] == ("A", "anomaly")


def test_alignment_kernel():
    sim = align.similarity_matrix(["we go home", "yes", "so long then"], ["hello", "we go home", "so long then", "bye"])
    assert align.best_path(sim) == [(0, 1), (2, 2)]
    assert align.best_path(align.similarity_matrix([], ["a"])) == []


def test_fills():
    def row(text, who=None, line=None, sim=None, scene=1, at=0.0):
        return {"text": text, "norm": align.norm_of(text), "speaker_ct": who, "utterance_ct": line, "match_similarity": sim, "scene_id": scene, "comm_dialogue_idx": 7 if who else None, "start_s": at, "end_s": at + 1, "fill_method": None, "filled_from": None}

    line = "We go home now. I saw the red fox. Then it rained hard. Nobody knew why."
    rows = [row("we go home now"), row("i saw the red fox", "Ann", line, 0.9), row("then it rained hard"), row("nobody knew why"), row("unrelated words here")]
    assert align.fill_from_anchors(rows) == 3 and [r["speaker_ct"] for r in rows] == ["Ann"] * 4 + [None]
    rows = [row("i saw the red fox", "Ann", "I saw the red fox. Then it rained hard. Nobody knew why.", 0.9, at=0), row("then it rained hard", at=1.1), row("nobody knew why", "Bob", "Nobody knew why", 0.9, at=9)]
    assert align.fill_directional(rows) == 1 and rows[1]["speaker_ct"] == "Ann" and rows[0]["utterance_ct"] == "I saw the red fox"
    rows = [row("i saw the red fox", "Ann", "I saw the red fox then it rained hard", 0.9), row("then it rained hard", at=1.1), row("other")]
    assert align.fill_residual(rows) == 1 and rows[2]["speaker_ct"] is None
    assert align.fill_from_anchors([]) == align.fill_directional([]) == align.fill_residual([]) == 0


def test_fills_in_stretches_equal_whole_entities(spark):
    rng = random.Random(21)
    lines = ["we went home. it was late. nobody saw us", "look at the moon! it is red. run now", "call the doctor. he is out. try again", "yes"]
    schema = "e string, idx bigint, norm string, start_s double, end_s double, scene_id int, speaker_ct string, utterance_ct string, comm_dialogue_idx bigint, match_similarity double, fill_method string"
    rows = []
    for e in range(60):
        for i in range(rng.randrange(1, 30)):
            line = rng.choice(lines)
            text = align.norm_of(rng.choice(line.split(". ")))
            typed = rng.random() < 0.55
            rows.append((f"e{e}", i * 3, text, float(i), i + 0.5, rng.choice([1, 1, 2, None]), rng.choice("AB") if typed else None, line if typed else None, i if typed else None, rng.choice([0.9, 0.95]) if typed else None, "align" if typed else None))
    df = spark.createDataFrame(rows, schema)
    got = {(r.e, r.idx): (r.speaker_ct, r.utterance_ct, r.fill_method, r.filled_from, r.scene_id) for r in align.apply_fills(df, ["e"]).collect()}
    names, filled = schema.replace(",", "").split()[::2], 0
    for e in range(60):
        whole = [dict(zip(names, r)) for r in rows if r[0] == f"e{e}"]
        align.fill_stretch(whole, (align.fill_from_anchors, align.fill_directional, align.fill_residual))
        for r in whole:
            filled += r["filled_from"] is not None
            assert got[r["e"], r["idx"]] == (r["speaker_ct"], r["utterance_ct"], r["fill_method"], r["filled_from"], r["scene_id"])
    assert filled > 10 and len(got) == len(rows)
    assert align.apply_fills(df.limit(0), ["e"]).count() == 0


def test_similarity():
    assert S.ratio("", "") == 1.0 and S.ratio("abcd", "abxd") == 0.75 and S.lcs_length("xaxbxc", "abc") == 3
    assert S.token_set_ratio("a b", "b a c") == 1.0 and S.text_similarity("", "a") == 0.0 and S.text_similarity("same words", "same words") == 1.0
    assert S.without_best_span("one two three four", "two three") == "one four" and S.without_best_span("one two", "zz qq") == "one two"


def test_text_columns(spark):
    df = spark.createDataFrame([("\t It’s (x) FINE…  ",), (None,), ("",), ("[door]",), ("Ohhh!",), ("Theme song plays",)], "t string")
    got = df.select(T.normalize_rule(F.col("t")).alias("r"), T.normalize_for_match(F.col("t")).alias("m"), T.word_count(F.col("t")).alias("n"), T.row_type(F.col("t")).alias("k")).collect()
    assert [r.r for r in got] == ["it's fine", "", "", "", "ohhh", "theme song plays"] and got[0].m == "it's fine"
    assert [r.n for r in got] == [4, 0, 0, 1, 1, 3] and [r.k for r in got] == ["dialogue", "empty", "empty", "direction", "reaction", "song"]
    d = spark.createDataFrame([("o'brien SPEAKER_01", "Show_s01E02b")], "a string, b string")
    r = d.select(T.title_case(F.col("a")).alias("a"), T.episode_root(F.col("b")).alias("b"), T.season_of(F.col("b")).alias("c"), T.series_of(F.col("b")).alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == ("O'Brien Speaker_01", "show_s01e02", "s1", "Show")
    c = spark.createDataFrame([("Hi (x). You there?! ; ...",), ("plain",), (None,)], "t string").select(T.split_chunks(F.col("t")).alias("c")).collect()
    assert [[x.raw for x in r.c] for r in c] == [["Hi", "You there"], ["plain"], []]


def test_propagation(spark):
    df = spark.createDataFrame([(1, 5, "A"), (2, 5, None), (3, 6, "A"), (4, 6, "B"), (5, 6, ""), (6, None, None)], "i int, g int, who string")
    out = {r.i: r.who for r in sequence.propagate_unique(df, ["g"], "who").collect()}
    assert out == {1: "A", 2: "A", 3: "A", 4: "B", 5: None, 6: None}


def test_missing_columns_are_added(spark):
    out = impute.complete_schema(spark.createDataFrame([("e", 1, "hi")], "episode string, scene_id int, utterance string"))
    r = out.collect()[0]
    assert out.columns[:3] == ["episode", "scene_id", "sentence_id"] and r.speaker == "" and r.review_flag is False and r.alignment_score == 0.0


def test_folds_take_empty_frames():
    empty = pd.DataFrame(columns=["speaker", "scene_id", "row_type", "utterance", "wc", "norm", "run", "speaker_ct", "speaker_confidence", "review_flag"])
    assert len(impute.fold_rows(empty)) == 0 and len(qa.fold_scene(empty)) == 0


def test_lookup_joins_agree(spark, monkeypatch):
    from turnloom.functions import staging

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)] + [(900, None)], "i bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k0", 3), (None, 4)], "k string, v int")
    rows = lambda: sorted((r.i, r.v) for r in staging.lookup_join(left, right, ["k"], salt_by="i").na.fill(-1, ["v"]).collect())
    small = rows()
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 1)
    assert rows() == small and len(small) == 201


def test_staged_tables_are_read_back(spark):
    from turnloom.functions import staging

    df = staging.stage(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), "x")
    assert df.collect()[0].b == [1, 2] and staging.stage(df.limit(0), "x").count() == 0


def test_restored_positions(spark):
    rows = spark.createDataFrame([("e", 5, "x"), ("e", 9, "y"), ("f", 1, "z")], "e string, pos int, t string")
    given = spark.createDataFrame([("e", 1, 0.5), ("e", 2, 1.5), ("f", 7, None)], "e string, pos int, start double")
    out = sorted((r.e, r.pos, r.start) for r in sequence.restore_by_position(rows, given, ["e"], "pos", ["start"]).collect() if r.start is not None)
    assert out == [("e", 5, 0.5), ("e", 9, 1.5)]
    with pytest.raises(Exception, match="row counts differ"):
        sequence.restore_by_position(rows.limit(2), given, ["e"], "pos", ["start"]).collect()


def test_episode_windows(spark):
    sim = spark.createDataFrame([("e", i, j, 1.0 if j - 20 == i else 0.1) for i in range(4) for j in range(40)], "e string, i int, j int, sim double")
    n = spark.createDataFrame([("e", 40), ("none", 12)], "e string, n bigint")
    out = {r.e: (r.start_idx, r.end_idx) for r in sequence.episode_window(sim, ["e"], "i", "j", "sim", n).collect()}
    assert out["e"] == (15, 24) and out["none"] == (0, 12)
    assert sequence.episode_window(sim, ["e"], "i", "j", "sim", n, 100).where("e = 'e'").collect()[0].end_idx == 40
    with pytest.raises(ValueError):
        sequence.episode_window(sim, ["e"], "i", "j", "sim", n, 0)


def test_components_of_open_graphs(spark):
    nodes = spark.createDataFrame([("e", x) for x in "ABCD"] + [("f", "A")], "episode string, character string")
    edges = spark.createDataFrame([("e", "A", "B", 1.0)], "episode string, source string, target string, weight double")
    assert {r.episode: r.n_components for r in metrics.component_counts(nodes, edges, ["episode"]).collect()} == {"e": 3, "f": 1}


def test_sessions_and_ends_over_blocks(spark):
    from datetime import datetime, timedelta

    rng, base = random.Random(3), datetime(2024, 1, 1, 22)
    times = sorted(base + timedelta(minutes=rng.randrange(6000)) for _ in range(60))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id bigint, event_id bigint, ts timestamp")
    got = sorted((r.session, r.n_events) for r in sequence.event_sessions(df).collect())
    want, last = [], None
    for t in times:
        if last is None or t - last >= timedelta(hours=4):
            want.append(0)
        want[-1] += 1
        last = t
    assert got == list(enumerate(want, 1))
    rows = spark.createDataFrame([("e", 0, 0.0, None), ("e", 1, 700.0, 690.0), ("e", 2, 2500.0, None), ("e", 3, None, None)], "e string, i int, start_s double, end_s double")
    assert {r.i: r.end_s for r in sequence.estimate_end_times(rows, ["e"], ["i"]).collect()} == {0: 700.0, 1: 2500.0, 2: 2500.5, 3: 0.0}


def test_lookups_of_many_bytes_are_not_broadcast(spark):
    from turnloom.functions import staging

    left = spark.range(300).select("id", (F.col("id") % 30).alias("k"))
    lookup = lambda size: spark.range(30).select(F.col("id").alias("k"), F.repeat(F.lit("x"), F.lit(size)).alias("v"))
    big = staging.lookup_join(left, lookup(1 << 20), ["k"], salt_by="id")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan(big) and "strategy=broadcast" in plan(staging.lookup_join(left, lookup(1 << 10), ["k"], salt_by="id"))
    assert big.agg(F.count("*"), F.sum(F.length("v"))).first()[:] == (300, 300 << 20)


def test_similarities_in_bulk_equal_those_one_by_one():
    rng = random.Random(7)
    words = ["the", "a", "trophy", "trophies", "it's", "é", "ßß", "ridiculous", "you", "know", "x" * 70]
    texts = ["", " ", "a", "a a", "x" * 64, "x" * 65, "q" * 63 + " q", "z" * 300, "b a", "a b", *(" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(60))]
    a, b = np.divmod(np.arange(len(texts) ** 2), len(texts))
    assert list(S.text_similarities(texts, a, b)) == [S.text_similarity(texts[i], texts[j]) for i, j in zip(a, b)]
    many = "".join(map(chr, range(200, 900)))
    assert S.text_similarities([many, "a"], np.array([0]), np.array([1]))[0] == S.text_similarity(many, "a")
    assert not len(S.text_similarities([], np.array([], dtype=int), np.array([], dtype=int)))


def test_alignment_compares_pairs_in_bulk(spark, monkeypatch):
    """Several groups together give what each gives alone, without a comparison one by one."""
    rng = random.Random(5)
    say = lambda: " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "hat", "then"], k=rng.randrange(1, 6)))
    s = [("e", g, i, say(), "") for g in range(5) for i in range(g * 2)]
    t = [("e", g, i, say(), "") for g in range(5) for i in range(9 - g)] + [("e", None, 1, "the cat", "")]
    cols = "root string, scene int, idx bigint, norm string, who string"
    want = set()
    for g in range(5):
        left, right = [r[3] for r in s if r[1] == g], [r[3] for r in t if r[1] == g]
        gain = np.array([[S.text_similarity(a, b) for b in right] for a in left]).reshape(len(left), len(right))
        score = {(i, 0): (-align.SKIP_LEFT * i, None) for i in range(len(left) + 1)} | {(0, j): (0.0, None) for j in range(len(right) + 1)}
        for i in range(1, len(left) + 1):
            for j in range(1, len(right) + 1):
                pair, up, side = score[i - 1, j - 1][0] + (gain[i - 1, j - 1] - 0.45) * 2.2, score[i - 1, j][0] - 0.6, score[i, j - 1][0] - 0.2
                best = max(pair, up, side)
                score[i, j] = best, 1 if pair == best else 2 if up == best else 3
        i, j = len(left), max(range(len(right) + 1), key=lambda j: score[len(left), j][0])
        while i and j:
            move = score[i, j][1]
            if move == 1:
                want.add((g, i - 1, j - 1))
            i, j = i - (move != 3), j - (move != 2)
    frames = spark.createDataFrame(s, cols), spark.createDataFrame(t, cols)
    got = align.align_monotonic(*frames, ["root", "scene"]).collect()
    assert {(r.scene, r.sent_idx, r.dialogue_idx) for r in got} == want and len(got) == len(want)
    gains = [np.array([[S.text_similarity(r[3], q[3]) for q in t if q[1] == g] for r in s if r[1] == g]).reshape(g * 2, 9 - g) for g in range(5)]
    assert align.best_paths(gains) == [align.best_paths([g])[0] for g in gains]


def test_long_groups_are_aligned_in_tiles(spark, monkeypatch):
    """A table in tiles gives the pairs of the whole table, whatever the shape, ties too."""
    rng = random.Random(8)
    say = lambda: " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "then"], k=rng.randrange(0, 4)))
    shapes = [(1, 30), (30, 1), (17, 23), (23, 17), (24, 24), (16, 8), (40, 9), (2, 2), (5, 0)]
    s = [(f"e{g}", i + 1, say(), rng.choice(["", "ann", "bob"])) for g, (n, _) in enumerate(shapes) for i in range(n)]
    t = [(f"e{g}", i + 1, say(), rng.choice(["", "ann", "bob"])) for g, (_, m) in enumerate(shapes) for i in range(m)]
    frames = [spark.createDataFrame(x, "episode string, idx bigint, norm string, who string").repartition(3) for x in (s, t)]
    for speakers in (False, True):
        want = sorted(align.align_monotonic(*frames, ["episode"], speakers).collect())
        with monkeypatch.context() as m:
            m.setattr(align, "WHOLE", 20)
            m.setattr(align, "SIDE", 8)
            m.setattr(align, "STRIP", 3)
            assert sorted(align.align_whole(*frames, ["episode"], speakers).collect()) == want
        assert sorted(align.align_whole(*frames, ["episode"], speakers).collect()) == want and len({r.episode for r in want}) > 5


def test_fuzzy_similarity_compares_in_bulk(monkeypatch):
    monkeypatch.setattr(S, "text_similarity", None)
    a, b = pd.Series(["the cat sat", None, "", "a mat"]), pd.Series(["the cat sat", "x", None, "the mat a"])
    assert list(S.fuzzy_similarity.func(a, b))[1:3] == [0.0, 0.0] and S.fuzzy_similarity.func(a, b)[0] == 1.0


def test_span_search_compares_only_what_may_win(monkeypatch):
    calls = []
    real = S.text_similarity
    monkeypatch.setattr(S, "text_similarity", lambda a, b: calls.append(a) or real(a, b))
    assert S.without_best_span("so the trophy is ridiculous he said the trophy is ridiculous", "the trophy is ridiculous") == "so he said the trophy is ridiculous"
    assert S.without_best_span("nobody saw the red door open that night in march", "quick jumps fix vowels") == "nobody saw the red door open that night in march"
    assert not calls
    assert S.without_best_span("tell marjorie the trophie is ridiculous now", "the trophy is ridiculous") == "tell marjorie now" and calls


def test_tables_of_unlike_sizes_are_filled_apart():
    """Padded to one size, these would take gigabytes."""
    gains = [np.ones((1500, 1)), *[np.ones((2, 2))] * 300, np.ones((1, 1500)), np.ones((0, 3))]
    paths = align.best_paths(gains)
    assert [len(p) for p in paths] == [1, *[2] * 300, 1, 0] and paths[1] == [(0, 0), (1, 1)]
    tables = (1500 + 1500 + 1) * len(gains) * (1500 + 1)
    assert tables > 100 * align.PADDED


def test_fills_compare_ahead_in_bulk(monkeypatch):
    """Stretches filled together give what each gives alone, without a comparison one by one."""
    rng = random.Random(4)
    lines = ["We went home now. It was very late. Nobody saw us there", "Look at the moon! It is red again. Run now please", "Call the doctor. He is out today. Try again later"]

    def stretch():
        rows = []
        for i in range(rng.randrange(3, 9)):
            line = rng.choice(lines)
            typed = i % 3 == 1
            rows.append({"idx": i, "norm": align.norm_of(rng.choice(line.split(". "))), "start_s": float(i), "end_s": i + 0.5, "scene_id": 1, "speaker_ct": "A" if typed else None, "utterance_ct": line if typed else None, "comm_dialogue_idx": i, "match_similarity": 0.9, "fill_method": None})
        return rows

    stretches = [stretch() for _ in range(80)]
    for step in (align.fill_from_anchors, align.fill_residual):
        alone, together = [[dict(r) for r in rows] for rows in stretches], [[dict(r) for r in rows] for rows in stretches]
        for rows in alone:
            step(rows)
        calls = []
        with monkeypatch.context() as m:
            m.setattr(align, "text_similarity", lambda a, b: calls.append(a) or S.text_similarity(a, b))
            align.fill_stretches(together, (step,))
        keys = ("speaker_ct", "utterance_ct", "fill_method", "scene_id", "match_similarity")
        assert [[[r[k] for k in keys] for r in rows] for rows in alone] == [[[r[k] for k in keys] for r in rows] for rows in together]
        filled = sum(r["filled_from"] is not None for rows in together for r in rows)
        assert filled > 20 and len(calls) < filled


def test_span_search_starts_from_the_likeliest_span():
    """Every span removed is the best of all."""
    rng = random.Random(2)
    real = S.text_similarity.__wrapped__
    for _ in range(150):
        words = rng.choices(["the", "old", "cat", "hat", "sat", "on", "red", "mats"], k=rng.randrange(1, 12))
        gone = [w if rng.random() < 0.8 else w[::-1] for w in words[rng.randrange(len(words)) :][: rng.randrange(1, 6)]]
        spans = [(k, i) for k in range(max(1, len(gone) - 3), min(len(words), len(gone) + 3) + 1) for i in range(len(words) - k + 1)]
        best = max(spans, key=lambda s: (real(" ".join(words[s[1] : s[1] + s[0]]), " ".join(gone)), -s[0], -s[1]), default=None)
        near = best and real(" ".join(words[best[1] : best[1] + best[0]]), " ".join(gone)) >= 0.55
        want = " ".join(words[: best[1]] + words[best[1] + best[0] :]) if near else " ".join(words)
        assert S.without_best_span.__wrapped__(" ".join(words), " ".join(gone)) == want


def test_nearest_values_both_ways(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 4)
    rng = random.Random(6)
    rows = [(e, i, rng.choice([None, None, None, i])) for e in "ab" for i in range(30)] + [("c", i, None) for i in range(6)]
    got = sequence.nearest_values(spark.createDataFrame(rows, "e string, i int, v int"), ["e"], "i", F.col("v"), "_before", "_after").collect()
    for r in got:
        known = [v for e, _, v in rows if e == r.e and v is not None]
        assert r._before == max((v for v in known if v <= r.i), default=None) and r._after == min((v for v in known if v >= r.i), default=None)
    assert len(got) == len(rows)


def test_forms_for_matching_in_python():
    assert T.match_words("\t It’s (x) FINE… [y [z]  ﬁve") == "it's fine five" and T.match_words("a (b") == "a b" and T.match_words(None) == ""
    assert T.speaker_words(" O’Brien (V.O.) ") == "o brien v o" and T.speaker_words(None) == ""


def test_stretches_that_a_fill_cannot_change_stay_out_of_python(spark, monkeypatch):
    def touch(rows):
        for r in rows:
            r["fill_method"] = "seen"

    monkeypatch.setitem(align.FILLABLE, touch, align.FILLABLE[align.fill_directional])
    scenes = [(1, 1, 1), (2, None, 2), (3, 3, 4), (5, 5, 5), (None, None, None)]
    rows = [("e", 10 * k + i, None if k == 3 and i == 1 else "a b", i / 1.0, i + 0.5, scene, None if i == 1 else "A", "X y. Z w. Q", 1, 0.9, None) for k, trio in enumerate(scenes) for i, scene in enumerate(trio)]
    df = spark.createDataFrame(rows, "e string, idx bigint, norm string, start_s double, end_s double, scene_id int, speaker_ct string, utterance_ct string, comm_dialogue_idx bigint, match_similarity double, fill_method string")
    assert {r.idx for r in align.apply_fills(df, ["e"], (touch,)).collect() if r.fill_method == "seen"} == {0, 1, 2}
    assert align.apply_fills(df, ["e"], (touch, align.fill_residual)).where("fill_method = 'seen'").count() == align.apply_fills(df, ["e"], ()).count() == 15


def test_residual_fill_removes_spans_only_where_the_rest_may_fit(monkeypatch):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choices(["the", "the", "a", "cat", "cats", "sat", "on", "mat", "ridiculous", "trophy", "you", "know"], k=rng.randrange(1, n)))
    skipped = 0
    for _ in range(4000):
        line, gone = say(14), rng.choice([say(7), ""])
        words = line.split()
        text = rng.choice([say(7), " ".join(words[rng.randrange(len(words)) :])])
        sim = max(S.text_similarity(text, " ".join(words[:i] + words[i + k :])) for k in range(min(len(words), len(gone.split()) + 3 if gone else 0) + 1) for i in range(len(words) - k + 1))
        for least in (0.5, 0.7, 0.9):
            may = align.rest_may_fit(text, line, gone, least)
            assert may or sim < least
            skipped += not may
    assert skipped > 2000
    monkeypatch.setattr(align, "without_best_span", None)
    rows = [{"norm": n, "speaker_ct": w, "utterance_ct": u, "start_s": 0.0, "end_s": 1.0} for n, w, u in (("i saw the red fox", "Ann", "I saw the red fox. Then it rained hard"), ("what on earth is banjo", None, None))]
    align.fill_stretch([dict(r, scene_id=1, idx=i, comm_dialogue_idx=None, match_similarity=None, fill_method=None) for i, r in enumerate(rows)], (align.fill_residual,))
