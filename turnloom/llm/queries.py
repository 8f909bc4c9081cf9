"""The pN queries over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import linkage, lookalikes, mojibake, names, nearest, packing, runs, tokens, turns
from turnloom.llm.sql import ORACLES as ORACLES
from turnloom.session import table

#: Seconds within which a shot counts as near.
SHOT_TOLERANCE = 1.5


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longest run of one speaker in a scene, single sentences too, with count and duration."""
    s = table(spark, sf_dir, "sentences")
    found = runs.collapse_runs(s, "episode", "scene_id", runs.speaker_key(F.col("speaker")), "sentence_id", "start_s", "end_s")
    return found.select(F.col("entity").alias("episode"), F.col("grp").cast("int").alias("scene_id"), F.col("symbol").alias("speaker_key"), F.col("first_pos").cast("int").alias("first_sentence_id"), F.col("last_pos").cast("int").alias("last_sentence_id"), "n_events", "start_s", "end_s", F.round("duration_s", 3).alias("duration_s"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_runs(spark, sf_dir).where("n_events >= 2").select("episode", "scene_id", "first_sentence_id", "last_sentence_id")


def p2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the canonical spelling it is attached to."""
    labels = table(spark, sf_dir, "speaker_labels").select("label_id", F.col("series_key").alias("series"), "label")
    typed = table(spark, sf_dir, "dialogues").select(F.col("episode_root").alias("episode"), F.col("speaker_ct").alias("label"))
    heard = table(spark, sf_dir, "sentences").select("episode", F.col("speaker").alias("label"))
    uses = typed.unionByName(heard).where("label is not null").select(F.regexp_extract("episode", r"^(.*?)_s", 1).alias("series"), "label")
    return names.attribute(labels, uses)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_names(p2_names(spark, sf_dir))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentence was spoken in which line, with the posterior as confidence."""
    return linkage.link_records(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "dialogues"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).select("dialogue_id", "sent_id").distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dialogues").select(F.lit("dialogues").alias("tbl"), F.col("dialogue_id").alias("row_id"), F.col("utterance_ct").alias("txt"))
    s = table(spark, sf_dir, "sentences").select(F.lit("sentences").alias("tbl"), F.col("sent_id").alias("row_id"), F.col("utterance").alias("txt"))
    return d.unionByName(s)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.find_lookalikes(_texts(spark, sf_dir))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    return lookalikes.unify(_texts(spark, sf_dir))


def _shots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entity = F.lower(F.trim("episode")).alias("entity")
    left = table(spark, sf_dir, "sentences").select(entity, F.col("start_s").alias("t"), F.col("sent_id").alias("id"))
    right = table(spark, sf_dir, "shots").select(entity, F.col("start_s").alias("t"), F.col("shot_id").alias("id"))
    return left, right


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shot that starts nearest each sentence, with the gap in seconds."""
    return nearest.nearest_records(*_shots(spark, sf_dir), SHOT_TOLERANCE).select(F.col("entity").alias("episode"), F.col("left_id").alias("sent_id"), F.col("right_id").cast("int").alias("shot_id"), F.round("gap", 3).alias("gap_s"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_nearest(spark, sf_dir).select("shot_id", "sent_id")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean speaker turns."""
    return turns.speaker_turns(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_map"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).where("speaker is not null").select("first_utt_id", "last_utt_id", "speaker")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces and their containers of ``packing.CAPACITY`` tokens."""
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_garbled(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    return mojibake.repair_garbled(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_names, p3_found, p3_links, p4_found, p4_unified, p5_found, p5_nearest, p6_found, p6_turns, p7_ids, p8_containers, p9_found, p9_restored)
}
