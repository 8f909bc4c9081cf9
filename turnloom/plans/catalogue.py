"""Every query over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import similarity as S
from turnloom.functions import text as T
from turnloom.functions.staging import stage
from turnloom.operators import align, impute, metrics, network, qa, sequence
from turnloom.plans import adapters as A
from turnloom.plans import oracles, pipeline, twins
from turnloom.session import table
from turnloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.ORACLES | twins.ORACLES
SCENE, EP = ["episode", "scene_id"], ["episode"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Networks


@query
def adjacency_counts(spark, d):
    return network.adjacency_counts(A.turns(spark, d))


@query
def proximity_scores(spark, d):
    return _round(network.proximity_scores(A.turns(spark, d)), "proximity")


@query
def copresence_pairs(spark, d):
    return network.copresence_pairs(A.turns(spark, d))


@query
def scene_edges(spark, d):
    return A.edges(spark, d)


@query
def episode_edges(spark, d):
    return network.episode_edges(A.edges(spark, d))


@query
def scene_bounds(spark, d):
    return network.scene_bounds(A.turns(spark, d)).withColumn("nodes", F.array_join("nodes", "|"))


@query
def episode_summary(spark, d):
    return network.episode_summary(A.turns(spark, d))


@query
def scene_graphs(spark, d):
    t = A.turns(spark, d)
    return network.scene_graphs(t, network.scene_edges(t)).select("episode", "scene_id", "start_s", "end_s", F.to_json("nodes").alias("nodes"), F.to_json("edges").alias("edges"))


@query
def event_edges(spark, d):
    return network.episode_edges_of(network.turns_of_events(table(spark, d, "events")), scenes=24)


@query
def lineitem_edges(spark, d):
    return network.scene_edges(A.lineitem_turns(spark, d)).groupBy("source", "target").agg((F.sum(F.round(F.col("weight") * 10000).cast("bigint")) / 10000).alias("weight"), F.count("*").alias("n_scenes"))


# Measures


@query
def scene_metrics(spark, d):
    t = A.turns(spark, d)
    return _round(metrics.scene_metrics(network.scene_nodes(t), network.scene_edges(t), network.scene_bounds(t), SCENE), "density", "duration_s", "interaction_density", "entropy")


@query
def interaction_entropy(spark, d):
    return _round(metrics.interaction_entropy(network.episode_edges(A.edges(spark, d)), EP), "entropy")


@query
def graph_density(spark, d):
    return _round(metrics.graph_density(A.nodes(spark, d), A.edges(spark, d), SCENE), "density")


@query
def edge_birth_death(spark, d):
    return metrics.edge_birth_death(A.edges(spark, d))


@query
def degree_strength_share(spark, d):
    return _round(metrics.strength_share(A.nodes(spark, d), A.edges(spark, d), SCENE), "value")


@query
def degree_unweighted(spark, d):
    return _round(metrics.degree_unweighted(A.nodes(spark, d), A.edges(spark, d), SCENE), "value")


@query
def dominant_character(spark, d):
    return _round(metrics.dominant_character(A.nodes(spark, d), A.edges(spark, d), SCENE), "value")


@query
def interaction_matrix(spark, d):
    return metrics.interaction_matrix(network.episode_edges(A.edges(spark, d)), EP)


def _cast(spark, d):
    return A.nodes(spark, d).select("episode", "character").distinct()


@query
def centrality_ranking(spark, d):
    return _round(metrics.centrality_ranking(_cast(spark, d), network.episode_edges(A.edges(spark, d)), EP), "value")


@query
def centrality_timeseries(spark, d):
    return _round(metrics.centrality_timeseries(A.nodes(spark, d), A.edges(spark, d)), "value")


@query
def betweenness(spark, d):
    return _round(metrics.betweenness(A.nodes(spark, d), A.edges(spark, d), SCENE), "value")


@query
def eigenvector(spark, d):
    return _round(metrics.eigenvector(A.nodes(spark, d), A.edges(spark, d), SCENE), "value")


@query
def connected_components(spark, d):
    return metrics.connected_components(_cast(spark, d), network.episode_edges(A.edges(spark, d)), EP)


@query
def communities_louvain(spark, d):
    return metrics.communities(_cast(spark, d), network.episode_edges(A.edges(spark, d)), EP, "louvain")


@query
def communities_girvan_newman(spark, d):
    return metrics.communities(A.nodes(spark, d), A.edges(spark, d), SCENE, "girvan_newman")


# Sequences


@query
def word_sessionization(spark, d):
    u = A.utterances(spark, d).select("episode", "idx", "speaker", "start_s", "end_s", F.col("text").alias("word"))
    return sequence.word_sessionization(u, EP, "idx")


@query
def event_sessions(spark, d):
    return sequence.event_sessions(table(spark, d, "events"))


@query
def estimate_end_times(spark, d):
    return sequence.estimate_end_times(A.utterances(spark, d).select("utt_id", "episode", "idx", "start_s", "end_s"), EP, ["idx"])


@query
def fill_scene_ids(spark, d):
    return sequence.fill_scene_ids(A.sentences(spark, d).select("sent_id", "episode", "sentence_id", "scene_id"), EP, "sentence_id")


@query
def scene_ids_from_markers(spark, d):
    e = readers.classify_lines(A.transcript_lines(spark, d)).select("doc_id", "line_no", "kind")
    return sequence.scene_ids_from_markers(e, ["doc_id"], "line_no", F.col("kind") == "scene")


@query
def scene_marker_rows(spark, d):
    s = A.sentences(spark, d).select("episode", "sentence_id", F.col("scene_id").cast("string").alias("scene"))
    return sequence.scene_marker_rows(s, EP, "sentence_id", "scene")


@query
def prev_next_speaker(spark, d):
    return sequence.prev_next_speaker(A.sentences(spark, d).select("sent_id", "episode", "sentence_id", "scene_id", "speaker"), EP, "sentence_id").select("sent_id", "prev_speaker_scene", "next_speaker_scene")


@query
def nearest_known_speaker(spark, d):
    return sequence.nearest_known_speaker(A.sentences(spark, d).select("sent_id", "episode", "sentence_id", "scene_id", "speaker"), EP, "sentence_id").select("sent_id", "prev_known", "next_known")


@query
def review_queue_context(spark, d):
    s = A.sentences(spark, d).select("sent_id", "episode", "sentence_id", "speaker_confidence")
    return sequence.review_queue(s, EP, "sentence_id", F.col("speaker_confidence").isin("low", "unresolved"))


@query
def scene_by_dialogue(spark, d):
    e = readers.parse_transcript(A.transcript_lines(spark, d), ["doc_id"])
    return sequence.scene_by_dialogue(e, ["doc_id"], "line_no").select("doc_id", "dialogue_idx", "scene")


@query
def interval_join_shot(spark, d):
    return sequence.shot_at(A.sentences(spark, d).select("sent_id", "episode", "start_s"), A.shots(spark, d), "episode", "start_s", "sent_id")


@query
def asof_shot(spark, d):
    return sequence.asof_shot(A.sentences(spark, d).select("sent_id", "episode", "start_s"), A.shots(spark, d), "episode", "start_s", "sent_id")


@query
def interval_join_words(spark, d):
    w = A.utterances(spark, d).select("episode", "idx", "start_s", "end_s")
    s = A.sentences(spark, d).where("start_s is not null").select("episode", F.col("sentence_id").alias("idx"), "start_s", "end_s")
    return sequence.words_to_sentences(w, s, EP)


def _spoken_words(spark, d):
    w = A.utterances(spark, d).select("episode", "idx", "start_s", "end_s")
    s = A.sentences(spark, d).where("start_s is not null").select("episode", F.col("sentence_id").alias("idx"), "start_s", "end_s", "speaker")
    return pipeline.words_with_speakers(w, s, EP)


@query
def word_speakers(spark, d):
    """Each word with its sentence's speaker."""
    return _spoken_words(spark, d)


@query
def word_stats(spark, d):
    return pipeline.word_stats(_spoken_words(spark, d), EP)


@query
def unique_group_propagation(spark, d):
    rows = A.matched_sentences(spark, d).select("sent_id", "episode", "scene_id", "norm", "speaker_ct")
    return sequence.propagate_unique(rows, ["episode", "norm"], "speaker_ct").select("sent_id", "speaker_ct", "fill_method")


@query
def scene_summary(spark, d):
    return sequence.scene_summary(A.sentences(spark, d), A.shots(spark, d)).withColumn("shot_ids", F.array_join(F.col("shot_ids").cast("array<string>"), ","))


@query
def scenes_from_rows(spark, d):
    s = A.sentences(spark, d)
    at = sequence.shot_at(s.select("sent_id", "episode", "start_s"), A.shots(spark, d), "episode", "start_s", "sent_id")
    found = sequence.scenes_from_rows(s.join(at, "sent_id", "left"), "sentence_id")
    return found.withColumns({"speakers": F.array_join("speakers", "|"), "utterance_indices": F.array_join(F.col("utterance_indices").cast("array<string>"), ",")})


def _overlaps(spark, d):
    """Token overlap of every sentence and line of a scene; texts are cut into tokens before they meet."""
    s = A.sentences(spark, d).where("scene_id is not null").select(T.episode_root(F.col("episode")).alias("root"), "scene_id", "sent_id", "sentence_id", S.tokens(T.normalize_rule(F.col("utterance"))).alias("a"))
    t = A.dialogues(spark, d).where("scene_idx is not null").select(F.col("episode_root").alias("root"), F.col("scene_idx").alias("scene_id"), "dialogue_id", "dialogue_idx", S.tokens(T.normalize_rule(F.col("utterance_ct"))).alias("b"))
    return s.join(t, ["root", "scene_id"]).withColumn("sim", F.round(S.set_overlap(F.col("a"), F.col("b")), 6))


@query
def similarity_matrix_topk(spark, d):
    """The two most similar lines of its scene for each sentence: the top-k is the feature."""
    from pyspark.sql import Window as W

    ranked = _overlaps(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("sent_id").orderBy(F.desc("sim"), "dialogue_id")))
    return ranked.where("rank <= 2").select("sent_id", "dialogue_id", "sim", "rank")


@query
def sliding_window_best(spark, d):
    from pyspark.sql import Window as W

    o = _overlaps(spark, d)
    place = o.select("root", "scene_id", "dialogue_id", "dialogue_idx").distinct().withColumn("j", F.row_number().over(W.partitionBy("root", "scene_id").orderBy("dialogue_idx", "dialogue_id")) - 1)
    n = place.groupBy("root", "scene_id").agg(F.count("*").alias("n"))
    sim = o.join(place.select("dialogue_id", "j"), "dialogue_id").select("root", "scene_id", "sent_id", "j", "sim")
    return sequence.sliding_window_best(sim, ["root", "scene_id"], "sent_id", "j", "sim", 5, n)


@query
def episode_window_search(spark, d):
    """Where the sentences of a scene lie among its lines, by the default window."""
    from pyspark.sql import Window as W

    o = _overlaps(spark, d)
    keys = ["root", "scene_id"]
    at = o.select(*keys, "dialogue_id", "dialogue_idx").distinct().withColumn("j", F.row_number().over(W.partitionBy(*keys).orderBy("dialogue_idx", "dialogue_id")) - 1)
    said = o.select(*keys, "sent_id", "sentence_id").distinct().withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("sentence_id", "sent_id")) - 1)
    sim = o.join(at.select("dialogue_id", "j"), "dialogue_id").join(said.select("sent_id", "i"), "sent_id").select(*keys, "i", "j", "sim")
    return sequence.episode_window(sim, keys, "i", "j", "sim", at.groupBy(*keys).agg(F.count("*").alias("n")))


@query
def restore_times(spark, d):
    """Times put back by position into rows that had lost them."""
    s = A.sentences(spark, d)
    return sequence.restore_by_position(s.select("sent_id", "episode", "sentence_id"), s, EP, "sentence_id", ["start_s", "end_s"])


# Text


@query
def normalize_text_rule(spark, d):
    return A.sentences(spark, d).select("sent_id", T.normalize_rule(F.col("utterance")).alias("norm"))


@query
def normalize_text_match(spark, d):
    return A.dialogues(spark, d).select("dialogue_id", T.normalize_for_match(F.col("utterance_ct")).alias("norm"))


@query
def normalize_speaker(spark, d):
    return A.dialogues(spark, d).select("dialogue_id", T.normalize_speaker(F.col("speaker_ct")).alias("who"))


@query
def word_count(spark, d):
    return A.sentences(spark, d).select("sent_id", T.word_count(F.col("utterance")).alias("n_words"))


@query
def classify_row_type(spark, d):
    return A.utterances(spark, d).select("utt_id", T.row_type(F.col("text")).alias("row_type"))


@query
def name_mentions(spark, d):
    cast = table(spark, d, "speaker_map").withColumn("given", F.element_at(F.split("canonical_name", " "), 1)).groupBy("episode").agg(F.array_sort(F.collect_set("given")).alias("names"))
    found = A.sentences(spark, d).join(cast, "episode").select("sent_id", T.mentions(F.col("utterance"), F.col("names")).alias("m"))
    return found.where(F.size("m") > 0).select("sent_id", F.array_join("m", "|").alias("mentions"))


@query
def confidence_bucket(spark, d):
    s = A.sentences(spark, d)
    b = T.confidence_bucket(F.col("alignment_score"), F.col("alignment_score") >= 0.52)
    return s.select("sent_id", b["confidence"].alias("confidence"), b["method"].alias("method"))


@query
def split_chunks(spark, d):
    return A.dialogues(spark, d).select("dialogue_id", F.posexplode(T.split_chunks(F.col("utterance_ct"))).alias("pos", "c")).select("dialogue_id", "pos", "c.raw", "c.norm")


@query
def episode_key_parse(spark, d):
    s = table(spark, d, "shots").select("episode").distinct()
    return s.select("episode", T.episode_root(F.col("episode")).alias("root"), T.season_of(F.col("episode")).alias("season"), T.series_of(F.lower(F.trim("episode"))).alias("series"))


@query
def append_note(spark, d):
    s = A.sentences(spark, d)
    return s.select("sent_id", T.append_note(F.col("speaker_method"), F.col("speaker_confidence")).alias("notes"))


@query
def title_case_speaker(spark, d):
    return A.utterances(spark, d).select("utt_id", T.title_case(F.col("speaker")).alias("speaker"))


@query
def token_overlap_similarity(spark, d):
    return _overlaps(spark, d).select("sent_id", "dialogue_id", "sim")


@query
def parse_transcript(spark, d):
    return readers.parse_transcript(A.transcript_lines(spark, d), ["doc_id"]).select("doc_id", "line_no", "kind", "scene_idx", "dialogue_idx", "scene_desc", "speaker_ct", "utterance_ct")


# Alignment and fills


def _scened(df, entity, pos):
    """Rows without a scene take the last known one before them, at the head of an entity the first one after; 1 if none is."""
    near = sequence.nearest_values(df, entity, pos, F.col("scene_id"), "_before", "_after")
    return near.withColumn("scene_id", F.coalesce("_before", "_after", F.lit(1)).cast("int")).drop("_before", "_after")


def _aligned_inputs(spark, d, *also):
    """All sentences and lines in the forms they are compared in, staged as several steps read them; those without a scene
    are in the one they stand in. ``also``: other columns of the sentences to keep."""
    s = _scened(A.sentences(spark, d).select("sent_id", "episode", "scene_id", "sentence_id", "start_s", "end_s", "utterance", "speaker"), EP, "sentence_id")
    t = _scened(A.dialogues(spark, d).select("dialogue_id", "episode_root", F.col("scene_idx").alias("scene_id"), "dialogue_idx", "speaker_ct", "utterance_ct"), ["episode_root"], "dialogue_idx")
    sn = s.select(T.episode_root(F.col("episode")).alias("root"), "episode", "scene_id", F.col("sent_id").alias("idx"), "start_s", "end_s", T.normalize_for_match("utterance").alias("norm"), T.normalize_speaker("speaker").alias("who"), *also)
    tn = t.select(F.col("episode_root").alias("root"), "scene_id", F.col("scene_id").alias("scene_idx"), F.col("dialogue_id").alias("idx"), "speaker_ct", "utterance_ct", T.normalize_for_match("utterance_ct").alias("norm"), T.normalize_speaker("speaker_ct").alias("who"))
    return stage(sn, "said"), stage(tn, "typed")


@query
def align_monotonic(spark, d):
    """The sentences of each recording, in the order spoken, aligned with all lines of its root, whatever their scenes."""
    placed = lambda by, pos, i: F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(pos), i)).cast("bigint").alias("idx")
    said = A.sentences(spark, d).where("episode is not null").select(T.episode_root(F.col("episode")).alias("root"), "episode", "sent_id", placed("episode", "sentence_id", "sent_id"), T.normalize_for_match("utterance").alias("norm"), F.lit("").alias("who"))
    typed = A.dialogues(spark, d).select(F.col("episode_root").alias("root"), "dialogue_id", placed("episode_root", "dialogue_idx", "dialogue_id"), T.normalize_for_match("utterance_ct").alias("norm"), F.lit("").alias("who"))
    said, typed = stage(said, "said"), stage(typed, "typed")
    parts = said.select("root", "episode").distinct()
    pairs = align.align_whole(said, typed.join(parts, "root"), ["root", "episode"])
    ids = pairs.join(said.select("episode", F.col("idx").alias("sent_idx"), "sent_id"), ["episode", "sent_idx"]).join(typed.select("root", F.col("idx").alias("dialogue_idx"), "dialogue_id"), ["root", "dialogue_idx"])
    return _round(ids.select("root", "episode", F.col("sent_id").alias("sent_idx"), F.col("dialogue_id").alias("dialogue_idx"), "sim"), "sim")


@query
def align_monotonic_speakers(spark, d):
    return _round(align.align_monotonic(*_aligned_inputs(spark, d), ["root", "scene_id"], with_speakers=True), "sim")


def _annotated(spark, d):
    sn, tn = _aligned_inputs(spark, d)
    mapped = align.map_speakers(sn.withColumnRenamed("scene_id", "scene"), tn.withColumnRenamed("scene_id", "scene"), align.align_monotonic(sn, tn, ["root", "scene_id"]).withColumnRenamed("scene_id", "scene"), ["root", "scene"])
    return mapped


@query
def anchor_chunk_fill(spark, d):
    return _round(align.apply_fills(_annotated(spark, d), EP, (align.fill_from_anchors,)), "match_similarity")


@query
def directional_residual_fill(spark, d):
    return _round(align.apply_fills(_annotated(spark, d), EP, (align.fill_directional,)), "match_similarity")


@query
def neighbor_residual_fill(spark, d):
    return _round(align.apply_fills(_annotated(spark, d), EP, (align.fill_residual,)), "match_similarity")


@query
def annotation_stats(spark, d):
    filled = stage(align.apply_fills(_annotated(spark, d), EP).select(*EP, "comm_dialogue_idx", "speaker_ct", "fill_method"), "filled")  # read twice
    spread = sequence.propagate_unique(filled, ["episode", "comm_dialogue_idx"], "speaker_ct", "_how")
    return pipeline.annotation_stats(spread.withColumn("fill_method", F.coalesce("_how", "fill_method")), EP)


def _paired(spark, d):
    """The aligned pairs with the rule forms of both texts and both speakers."""
    sn, tn = _aligned_inputs(spark, d, "utterance", "speaker")
    pairs = align.align_monotonic(sn, tn, ["root", "scene_id"]).select("sent_idx", "dialogue_idx")
    left = sn.select(F.col("idx").alias("sent_idx"), T.normalize_rule(F.col("utterance")).alias("a"), T.normalize_rule(F.col("speaker")).alias("x"))
    right = tn.select(F.col("idx").alias("dialogue_idx"), T.normalize_rule(F.col("utterance_ct")).alias("b"), T.normalize_rule(F.col("speaker_ct")).alias("y"))
    return pairs.join(left, "sent_idx").join(right, "dialogue_idx").select(F.col("sent_idx").alias("sent_id"), F.col("dialogue_idx").alias("dialogue_id"), "a", "b", "x", "y")


@query
def fuzzy_similarity(spark, d):
    """How alike the texts and the speakers of aligned pairs are."""
    return _round(_paired(spark, d).select("sent_id", "dialogue_id", S.fuzzy_similarity("a", "b").alias("sim"), S.fuzzy_similarity("x", "y").alias("name_sim")), "sim", "name_sim")


@query
def length_ratio_filter(spark, d):
    """Words of a sentence over those of its aligned line, and whether they are twice as many at most."""
    p = _paired(spark, d)
    return _round(p.select("sent_id", "dialogue_id", align.length_ratio(F.col("a"), F.col("b")).alias("ratio"), align.length_ok(F.col("a"), F.col("b"), 2.0).alias("length_ok")), "ratio")


@query
def best_span_removal(spark, d):
    """What is left of aligned lines without the words of their sentence."""
    return _paired(spark, d).select("sent_id", S.span_removed("b", "a").alias("rest"))


@query
def alignment_rows(spark, d):
    sn, tn = _aligned_inputs(spark, d)
    keys = ["root", "scene_id"]
    scenes = tn.select(*keys, F.col("idx").alias("dialogue_idx"), F.concat(F.lit("scene "), F.col("scene_idx").cast("string")).alias("scene"))
    rows = align.alignment_rows(sn, align.align_monotonic(sn, tn, keys), tn, scenes, keys)
    return _round(rows.select("episode", "idx", "speaker_ct", "utterance_ct", "scene_desc", "alignment_score", "speaker_confidence", "speaker_method"), "alignment_score")


# Imputation and quality


def _filled(spark, d):
    rows = A.matched_sentences(spark, d).select("sent_id", "episode", "season", "scene_id", "sentence_id", "utterance", "speaker", "utterance_ct", "speaker_ct")
    return rows


@query
def direct_ct_fill(spark, d):
    return impute.direct_fill(_filled(spark, d)).select("sent_id", "speaker", "speaker_original", "row_type", "matched_to_ct", "filled_from_missing", "speaker_method", "speaker_confidence", "alignment_score", "notes")


@query
def speaker_rule_cascade(spark, d):
    rows = impute.cascade(impute.direct_fill(_filled(spark, d)), EP, "sentence_id")
    return _round(rows.select("sent_id", "speaker", "filled_from_missing", "speaker_method", "speaker_confidence", "alignment_score", "review_flag", "review_reason", "notes"), "alignment_score")


@query
def review_flagging(spark, d):
    return impute.stamp_review(impute.direct_fill(_filled(spark, d))).select("sent_id", "speaker_method", "speaker_confidence", "alignment_score", "review_flag", "review_reason")


@query
def fill_summary(spark, d):
    return impute.fill_summary(impute.stamp_review(impute.direct_fill(_filled(spark, d))), ["season", "episode"])


@query
def enhanced_rows(spark, d):
    """The whole fill stage with the context columns."""
    rows = pipeline.fill_speakers(_filled(spark, d), EP, "sentence_id")
    return _round(impute.scene_context(rows, EP, "sentence_id"), "alignment_score")


@query
def scene_majority(spark, d):
    return impute.scene_majority(A.sentences(spark, d).where("scene_id is not null"), SCENE, "sentence_id")


@query
def scene_speaker_set(spark, d):
    return impute.scene_speaker_set(A.sentences(spark, d).where("scene_id is not null"), SCENE, "sentence_id")


@query
def scene_anomalies(spark, d):
    return qa.one_off_speakers(A.sentences(spark, d).where("scene_id is not null"), SCENE)


def _checked(spark, d):
    """Sentences as enhanced rows: unmatched medium and low ones under review."""
    rows = A.matched_sentences(spark, d).select("sent_id", "episode", "season", "scene_id", "sentence_id", "utterance", "speaker", "speaker_ct", "speaker_confidence", "speaker_method", "alignment_score")
    return rows.withColumns({"speaker": T.clean(F.col("speaker")), "speaker_ct": T.clean(F.col("speaker_ct")), "alignment_score": F.coalesce("alignment_score", F.lit(0.0)), "review_flag": F.coalesce(F.col("speaker_confidence").isin("low", "none"), F.lit(False)), "review_reason": F.lit(""), "notes": F.lit("")})


@query
def qa_ct_override(spark, d):
    return qa.ct_override(_checked(spark, d)).where("new_speaker is not null").select("sent_id", "new_speaker", "qa_reason")


@query
def qa_changes(spark, d):
    return qa.changes(qa.ct_override(_checked(spark, d)), ["sent_id", "episode", "scene_id", "sentence_id"], F.lit(qa.CORRECTIONS["ct"][0]))


@query
def qa_bridge(spark, d):
    return qa.scene_corrections(_checked(spark, d), EP, "sentence_id", anomaly=False).where("fix <> ''").select("sent_id", "new_speaker", "fix", "qa_reason")


@query
def qa_anomaly(spark, d):
    return qa.scene_corrections(_checked(spark, d), EP, "sentence_id", bridge=False).where("fix <> ''").select("sent_id", "new_speaker", "fix", "qa_reason")


@query
def qa_review_resolution(spark, d):
    return qa.resolve_reviews(_checked(spark, d), EP, "sentence_id").where("resolved is not null").select("sent_id", "resolved", "speaker_confidence", "speaker_method", "alignment_score")


@query
def qa_rollup(spark, d):
    return qa.rollup(_checked(spark, d), "season", "episode")


@query
def qa_final_rows(spark, d):
    """All corrections in order."""
    rows, _ = qa.run_all(_checked(spark, d), EP, "sentence_id")
    return rows.select("sent_id", "speaker", "speaker_method", "speaker_confidence", "alignment_score", "review_flag", "notes").withColumn("alignment_score", F.round("alignment_score", 6))


@query
def qa_summary(spark, d):
    """What the corrections did to each file."""
    before = _checked(spark, d)
    rows, (one, two) = qa.run_all(before, EP, "sentence_id")
    return qa.summary(before, rows, one.unionByName(two), ["season", "episode"])
