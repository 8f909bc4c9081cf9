"""The stages as functions from tables to tables; nothing is handed over in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import align, impute, metrics, network, qa, sequence


def extract_annotations(sentences: DataFrame, lines: DataFrame, keys: list[str], fills: list[str], min_similarity: float = 0.52, cap: float = 5.0) -> DataFrame:
    """Speakers and scenes of timed sentences from typed lines: alignment in groups of ``keys``, acceptance, the fills
    within ``fills``, propagation along dialogue indices, scenes filled forward.

    ``sentences`` has idx, text, start_s, end_s and speaker, ``lines`` idx, scene_idx, speaker_ct and utterance_ct.
    """
    s = sentences.withColumns({"norm": T.normalize_for_match(F.col("text")), "who": T.normalize_speaker(F.col("speaker"))})
    d = lines.withColumns({"norm": T.normalize_for_match(F.col("utterance_ct")), "who": T.normalize_speaker(F.col("speaker_ct"))})
    aligned = align.align_monotonic(s, d, keys)
    mapped = align.map_speakers(s.drop("scene_id") if "scene_id" in s.columns and "scene_id" not in [*keys, *fills] else s, d, aligned, keys, min_similarity, cap)
    filled = align.apply_fills(mapped, fills)
    kept = mapped.select(*fills, "idx", "text", "start_s", "end_s", "speaker").join(filled, [*fills, "idx"])
    spread = sequence.propagate_unique(kept, [*fills, "comm_dialogue_idx"], "speaker_ct", "_how")
    done = spread.withColumn("fill_method", F.coalesce("_how", "fill_method")).drop("_how")
    return sequence.fill_scene_ids(done, fills, "idx")


def words_with_speakers(words: DataFrame, sentences: DataFrame, entity: list[str]) -> DataFrame:
    """Words with the sentence they belong to and its speaker (empty if the sentence has none, null if the word has no
    sentence). Both sides as for ``words_to_sentences``; the sentences have speaker too."""
    placed = sequence.words_to_sentences(words, sentences, entity)
    said = sentences.select(*entity, F.col("idx").alias("sentence_idx"), F.coalesce(F.trim("speaker"), F.lit("")).alias("speaker"))
    return placed.join(said, [*entity, "sentence_idx"], "left").select(*entity, "idx", "sentence_idx", "speaker")


def word_stats(words: DataFrame, entity: list[str]) -> DataFrame:
    """How many words have a sentence, and how many a speaker."""
    return words.groupBy(*entity).agg(F.count("*").alias("n_words"), F.count("sentence_idx").alias("n_in_sentences"), F.count_if(F.coalesce("speaker", F.lit("")) != "").alias("n_with_speaker"))


def annotation_stats(done: DataFrame, entity: list[str]) -> DataFrame:
    """How many sentences each stage gave a speaker, and how many have none."""
    by = lambda m: F.count_if(F.col("fill_method") == m).alias(f"n_{m}")
    return done.groupBy(*entity).agg(F.count("*").alias("n_sentences"), *[by(m) for m in ("align", "anchor_chunk", "scene_directional_residual", "neighbor_residual", "dialogue_propagation")], F.count_if(F.coalesce("speaker_ct", F.lit("")) == "").alias("n_unfilled"))


def fill_speakers(rows: DataFrame, entity: list[str], pos: str, rules: impute.Rules = impute.Rules()) -> DataFrame:
    """Direct fills, the rule cascade, and review flags."""
    return impute.stamp_review(impute.cascade(impute.direct_fill(rows, rules), entity, pos, rules), rules)


def check_quality(rows: DataFrame, entity: list[str], pos: str) -> tuple[DataFrame, list[DataFrame]]:
    """The global corrections, and the logs of what they changed."""
    return qa.run_all(rows, entity, pos)


def build_network(rows: DataFrame, tie: list[str], window: int = 3, adjacency: float = 1.0, proximity: float = 0.5, copresence: float = 0.25, exclude: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """turns, nodes, scene_edges and episode_edges; speakers in ``exclude`` are left out."""
    t = network.turns(rows.where(~F.col("speaker").isin(*exclude)) if exclude else rows, tie)
    e = network.scene_edges(t, window, adjacency, proximity, copresence)
    return {"turns": t, "nodes": network.scene_nodes(t), "scene_edges": e, "episode_edges": network.episode_edges(e)}


def analyse(net: dict[str, DataFrame], measures: tuple[str, ...] = ("degree", "degree_unweighted", "betweenness", "eigenvector"), method: str = "louvain") -> dict[str, DataFrame]:
    """Scene measures, centralities of scenes and episodes, communities and edge lifetimes."""
    unknown = sorted(set(measures) - set(metrics.MEASURES))
    if unknown:
        raise ValueError(f"unknown measures {unknown}; known are {', '.join(metrics.MEASURES)}")
    scene = ["episode", "scene_id"]
    cast = net["nodes"].select("episode", "character").distinct()
    whole = None
    for m in measures:
        one = metrics.centrality(cast, net["episode_edges"], ["episode"], m).withColumn("measure", F.lit(m))
        whole = one if whole is None else whole.unionByName(one)
    return {
        "scene_metrics": metrics.scene_metrics(net["nodes"], net["scene_edges"], network.scene_bounds(net["turns"]), scene),
        "centrality_timeseries": metrics.centrality_timeseries(net["nodes"], net["scene_edges"], measures),
        "episode_centrality": whole,
        "communities": metrics.communities(cast, net["episode_edges"], ["episode"], method),
        "edge_birth_death": metrics.edge_birth_death(net["scene_edges"]),
    }
