import json

import pytest
from pyspark.sql import functions as F

from turnloom.operators import network
from turnloom.plans import catalogue, cli, pipeline
from turnloom.sources import readers, sinks


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_word_transcripts(spark, tmp_path):
    w = [{"word": "hi", "start": 1.0, "end": None, "speaker": "a"}, {"word": "you", "start": 0.5, "end": 0.9, "speaker": "b"}]
    for body in (w, {"words": w, "more": 1}):
        out = readers.read_words(spark, put(tmp_path / "w.json", body)).orderBy("start_s").collect()
        assert [(r.word, r.end_s, r.idx) for r in out] == [("you", 0.9, 1), ("hi", 1.0, 0)]
    with pytest.raises(Exception, match="lack"):
        readers.read_words(spark, put(tmp_path / "w.json", [{"content": "x", "start_time": 1}])).collect()
    assert readers.read_words(spark, put(tmp_path / "w.json", {"words": []})).count() == 0


def test_sentence_transcripts(spark, tmp_path):
    body = {"sentences": [{"text": " ", "start": 0.0}, {"text": "hi", "start": None, "end": None, "speaker": "a"}, {"text": "yo", "start": 2.0, "end": 3.0}]}
    out = readers.read_sentences(spark, put(tmp_path / "s.json", body)).orderBy("idx").collect()
    assert [(r.idx, r.text, r.start_s, r.end_s, r.speaker) for r in out] == [(1, "hi", 0.0, 0.0, "a"), (2, "yo", 2.0, 3.0, "")]


def test_shot_files(spark, tmp_path):
    tsv = put(tmp_path / "a.tsv", "onset\tduration\tonset_frame\n0\t2.5\t0\nbad\t1\t0\n2.5\t1.5\t60\n")
    assert [(r.shot_id, r.start_s, r.end_s) for r in readers.read_shots(spark, tsv).orderBy("shot_id").collect()] == [(1, 0.0, 2.5), (3, 2.5, 4.0)]
    legacy = put(tmp_path / "b.csv", "Timecode List:,00:00\nScene Number,Start Frame,Start Time (seconds),End Time (seconds)\n1,0,0.0,4.0\nx,1,2,3\n2,9,4.0,8.0\n")
    assert [(r.shot_id, r.end_s) for r in readers.read_shots(spark, legacy).orderBy("shot_id").collect()] == [(1, 4.0), (2, 8.0)]
    with pytest.raises(Exception, match="unsupported"):
        readers.read_shots(spark, put(tmp_path / "c.csv", "a,b\n1,2\n")).collect()


def test_transcripts(spark, tmp_path):
    path = put(tmp_path / "t.txt", "Ann: Hello\n\n[Scene: The shop]\nBob: Yes: no\n(Later)\nOpening Credits\nno name here\nCy:  \n")
    out = readers.read_transcripts(spark, path).orderBy("line_no").collect()
    assert [(r.kind, r.scene_idx, r.dialogue_idx) for r in out] == [("dialogue", 1, 0), ("scene", 2, None), ("dialogue", 2, 1), ("scene", 3, None), ("scene", 4, None), ("scene", 5, None), ("scene", 6, None)]
    assert out[1].scene_desc == "The shop" and out[2].utterance_ct == "Yes: no" and out[0].speaker_ct == "Ann"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\tnow', None), ("2", "two\nlines", "x")], "scene_id string, utterance string, note string")
    sinks.write_table(df, str(tmp_path / "t"))
    back = {r.scene_id: (r.utterance, r.note) for r in readers.read_table(spark, str(tmp_path / "t"), ("scene_id",)).collect()}
    assert back == {"1": ('say "hi"\tnow', ""), "2": ("two\nlines", "x")}
    with pytest.raises(ValueError):
        readers.read_enhanced_input(spark, str(tmp_path / "t"))


def test_json_and_graphs(spark, tmp_path):
    t = network.turns(spark.createDataFrame([("e", 1, i, float(i), i + 1.0, s) for i, s in enumerate("ABA")], "episode string, scene_id int, sentence_id int, start_s double, end_s double, speaker string"), ["sentence_id"])
    net = {"turns": t, "nodes": network.scene_nodes(t), "scene_edges": network.scene_edges(t)}
    net["episode_edges"] = network.episode_edges(net["scene_edges"])
    doc = sinks.episode_documents(net["episode_edges"], net["nodes"], network.episode_summary(t)).collect()[0].document
    put(tmp_path / "g.json", doc)
    back = readers.read_episode_graph(spark, str(tmp_path / "g.json")).collect()
    assert [(r.source, r.target, r.weight) for r in back] == [("A", "B", 3.25)]
    sinks.write_gexf(net["episode_edges"], str(tmp_path / "g.gexf"))
    assert "<edge " in (tmp_path / "g.gexf").read_text() and sinks.node_link(net["episode_edges"])["nodes"] == [{"id": "A"}, {"id": "B"}]
    graphs = network.scene_graphs(t, net["scene_edges"]).select("scene_id", "start_s", "end_s", "nodes", "edges")
    sinks.write_json_list(graphs, str(tmp_path / "n.json"))
    assert readers.read_scene_graphs(spark, str(tmp_path / "n.json")).collect()[0].nodes == ["A", "B"]
    found = pipeline.analyse(net)
    m = sinks.metrics_documents(found["scene_metrics"], found["episode_centrality"]).collect()[0].document
    assert json.loads(m)["episode_id"] == "e" and found["communities"].count() == 2
    with pytest.raises(ValueError):
        pipeline.analyse(net, ("fame",))
    with pytest.raises(Exception, match="not a list"):
        readers.read_scenes(spark, put(tmp_path / "x.json", {"a": 1})).collect()


def test_maps_bundles_and_discovery(spark, tmp_path):
    path = put(tmp_path / "m.json", {"SPEAKER_01": "Ann"})
    assert [(r.raw_label, r.canonical_name) for r in readers.read_speaker_map(spark, path).collect()] == [("SPEAKER_01", "Ann")]
    a, b = tmp_path / "x_s01e01a.tsv", tmp_path / "x_s01e01a_scene_summary.tsv"
    for p in (a, b):
        put(p, "scene_id\n1\n")
    (tmp_path / "final").mkdir()
    put(tmp_path / "final" / "x_s01e01a.tsv", "scene_id\n2\n")
    assert list(readers.discover(str(tmp_path))) == ["x_s01e01a"] and "final" in str(readers.discover(str(tmp_path))["x_s01e01a"])
    sinks.zip_files(str(tmp_path / "z.zip"), [a, b])
    assert [r.name for r in readers.read_zipped_tables(spark, str(tmp_path / "z.zip")).collect()] == ["x_s01e01a.tsv"]


def test_extract_annotations(spark):
    s = spark.createDataFrame([("r", "ra", 0, "we go home now", 0.0, 1.0, "x"), ("r", "ra", 1, "i saw the red fox", 1.0, 2.0, "x"), ("r", "ra", 2, "what", 2.0, 3.0, None)], "root string, episode string, idx int, text string, start_s double, end_s double, speaker string")
    d = spark.createDataFrame([("r", 0, 4, "Ann", "We go home now."), ("r", 1, 5, "Bob", "I saw the red fox!")], "root string, idx int, scene_idx int, speaker_ct string, utterance_ct string")
    out = {r.idx: (r.speaker_ct, r.scene_id) for r in pipeline.extract_annotations(s, d, ["root"], ["episode"]).collect()}
    assert out == {0: ("Ann", 4), 1: ("Bob", 5), 2: (None, 5)}


def test_command_line(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    put(src / "x_s01e01a.tsv", "scene_id\tsentence_id\tstart\tend\tutterance\tspeaker\tutterance_ct\tspeaker_ct\n" + "".join(f"1\t{i}\t{i}.0\t{i}.5\thello there\t{s}\t\t{c}\n" for i, (s, c) in enumerate([("Ann", ""), ("", "Bob"), ("", ""), ("Cy", "")], 1)))
    cli.main(["all", "--input", str(src), "--output", str(out), "--measures", "degree", "--season", "1"])
    enhanced = readers.read_table(spark, str(out / "enhanced"))
    assert enhanced.where(F.col("speaker") != "").count() == 4 and {"start", "notes", "scene_speaker_set"} <= set(enhanced.columns)
    assert {p.name for p in out.iterdir()} == {"enhanced", "review", "fill_summary", "final_cleaned", "qa_changes", "qa_summary", "qa_rollup", "scene_edges", "episode_edges", "temporal_network", "episode_network", "metrics", "scene_metrics", "centrality_timeseries", "episode_centrality", "communities", "edge_birth_death"}
    assert readers.read_table(spark, str(out / "qa_summary")).columns[:3] == ["episode", "rows", "review_rows_before_qa"]
    assert readers.read_table(spark, str(out / "qa_rollup")).collect()[0].total_rows == "4"
    cli.main(["fill", "--input", str(src), "--output", str(tmp_path / "none"), "--season", "s02"])
    assert readers.read_table(spark, str(tmp_path / "none" / "fill_summary")).count() == 0
    with pytest.raises(ValueError):
        cli.season_key("first")


def test_extraction_from_the_command_line(spark, tmp_path):
    for folder in ("said", "typed", "shots"):
        (tmp_path / folder).mkdir()
    put(tmp_path / "said" / "x_s01e01a.json", {"sentences": [{"text": t, "start": float(i), "end": i + 0.5, "speaker": ""} for i, t in enumerate(["we lost the old map", "look in the kitchen drawer", "that is empty too"])]})
    put(tmp_path / "typed" / "x_s01e01_ufs.txt", "[Scene: a room]\nAnn: We lost the old map.\nBob: Look in the kitchen drawer!\n[Scene: a yard]\nAnn: That is empty, too.\n")
    put(tmp_path / "shots" / "x_s01e01a.tsv", "onset\tduration\n0.0\t1.0\n1.0\t2.0\n")
    out = tmp_path / "out"
    cli.main(["extract", "--input", str(tmp_path / "said"), "--lines", str(tmp_path / "typed"), "--shots", str(tmp_path / "shots"), "--output", str(out)])
    rows = sorted((r.sentence_id, r.speaker, r.scene_id) for r in readers.read_table(spark, str(out / "sentences")).collect())
    assert rows == [("1", "Ann", "1"), ("2", "Bob", "1"), ("3", "Ann", "2")]
    stats = readers.read_table(spark, str(out / "annotation_stats")).collect()[0]
    assert (stats.n_sentences, stats.n_align) == ("3", "3") and readers.read_table(spark, str(out / "scene_summary")).count() == 2
    with pytest.raises(ValueError):
        cli.main(["extract", "--input", str(tmp_path / "said"), "--output", str(out)])


def test_words_become_utterances(spark, tmp_path):
    words = [("a", 2.0, 2.2, "ann lee"), ("b", 0.0, 0.2, "speaker_01"), ("c", 0.25, None, "SPEAKER_01"), ("d", 2.9, 3.0, "Ann Lee")]
    path = put(tmp_path / "w.json", [{"word": w, "start": s, "end": e, "speaker": k} for w, s, e, k in words])
    out = readers.read_utterances(spark, path, {"Speaker_01": "Bob"}).orderBy("start_s").collect()
    assert [(r.speaker, r.text, r.start_s, r.end_s) for r in out] == [("Bob", "b c", 0.0, 0.25), ("Ann Lee", "a", 2.0, 2.2), ("Ann Lee", "d", 2.9, 3.0)]


def test_rows_of_zipped_tables(spark, tmp_path):
    put(tmp_path / "a.tsv", "scene_id\tutterance\n1\thello\n2\tyes\n")
    sinks.zip_files(str(tmp_path / "z.zip"), [tmp_path / "a.tsv"])
    rows = readers.read_zipped_rows(spark, str(tmp_path / "z.zip"), ("utterance", "speaker")).collect()
    assert [(r.name, r.row_no, r.utterance, r.speaker) for r in rows] == [("a.tsv", 0, "hello", None), ("a.tsv", 1, "yes", None)]


def test_rows_without_a_scene_are_aligned(spark, tmp_path):
    sent = "sent_id bigint, episode string, season string, scene_id int, sentence_id int, start_s double, end_s double, speaker string, utterance string, alignment_score double, loaded_at timestamp"
    said = [("a", None, "we lost the map"), ("a", 1, "look in the kitchen drawer"), ("a", None, "that is empty too"), ("a", 2, "somebody stole the piano"), ("b", None, "call the museum now"), ("b", 2, "they are closed today"), ("b", None, "nothing like any line at all")]
    rows = [(i, f"x_s01e01{part}", "s01", scene, i, float(i), i + 0.5, None, text, None, None) for i, (part, scene, text) in enumerate(said)]
    spark.createDataFrame(rows, sent).write.parquet(str(tmp_path / "sentences.parquet"))
    typed = [(10 + i, "x_s01e01", i, scene, f"W{i}", said[i][2].capitalize(), None) for i, scene in enumerate([None, None, 1, None, 2, None])]
    typed[3] = (13, "x_s01e01", 3, 2, "W3", said[3][2], None)
    spark.createDataFrame(typed, "dialogue_id bigint, episode_root string, dialogue_idx int, scene_idx int, speaker_ct string, utterance_ct string, loaded_at timestamp").write.parquet(str(tmp_path / "dialogues.parquet"))
    q = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    pairs = [(i, 10 + i) for i in range(6)]
    for name in ("align_monotonic", "align_monotonic_speakers"):
        assert sorted((r.sent_idx, r.dialogue_idx) for r in q(name)) == pairs
    assert sorted((r.idx, r.speaker_ct, r.scene_desc) for r in q("alignment_rows")) == [(i, f"W{i}", f"scene {1 if i < 3 else 2}") for i in range(6)] + [(6, None, None)]
    for name in ("anchor_chunk_fill", "directional_residual_fill", "neighbor_residual_fill"):
        assert sorted((r.idx, r.speaker_ct) for r in q(name)) == [(i, f"W{i}") for i in range(6)] + [(6, None)]
    assert sorted((r.episode, r.n_sentences, r.n_align, r.n_unfilled) for r in q("annotation_stats")) == [("x_s01e01a", 4, 4, 0), ("x_s01e01b", 3, 2, 1)]


def test_recordings_are_aligned_whatever_their_scenes(spark, tmp_path):
    """A row in a wrong scene has its partner, and each recording is aligned with all lines of its root."""
    sent = "sent_id bigint, episode string, season string, scene_id int, sentence_id int, start_s double, end_s double, speaker string, utterance string, alignment_score double, loaded_at timestamp"
    texts = ["we lost the map", "look in the kitchen drawer", "somebody stole the piano", "call the museum now", "they are closed today"]
    said = [("a", 1, 0), ("a", 7, 1), ("a", 2, 2), ("b", 2, 2), ("b", 2, 3), ("b", None, 4)]
    rows = [(20 - i, f"x_s01e01{part}", "s01", scene, i, None, None, None, texts[k], None, None) for i, (part, scene, k) in enumerate(said)]
    spark.createDataFrame(rows, sent).write.parquet(str(tmp_path / "sentences.parquet"))
    typed = [(10 + i, "x_s01e01", i, scene, "W", texts[i].upper(), None) for i, scene in enumerate([1, 1, 3, 3, 9])]
    spark.createDataFrame(typed, "dialogue_id bigint, episode_root string, dialogue_idx int, scene_idx int, speaker_ct string, utterance_ct string, loaded_at timestamp").write.parquet(str(tmp_path / "dialogues.parquet"))
    got = catalogue.QUERIES["align_monotonic"](spark, str(tmp_path)).collect()
    assert sorted((r.episode, r.sent_idx, r.dialogue_idx) for r in got) == sorted((f"x_s01e01{part}", 20 - i, 10 + k) for i, (part, _, k) in enumerate(said))
