"""The given tables as canonical ones. Rows delivered twice are alike but for their load time, so one of each is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import network
from turnloom.session import table


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").drop("loaded_at").dropDuplicates(["sent_id"])


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dialogues").drop("loaded_at").dropDuplicates(["dialogue_id"])


def utterances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").drop("loaded_at").dropDuplicates(["utt_id"])


def shots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shots").drop("loaded_at").withColumn("episode", F.lower(F.trim("episode"))).dropDuplicates(["episode", "shot_id"])


def turns(spark: SparkSession, d: str) -> DataFrame:
    return network.turns(sentences(spark, d), ["sentence_id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return network.scene_edges(turns(spark, d))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.scene_nodes(turns(spark, d))


def lineitem_turns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scenes and suppliers as speakers: the bulk workload."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = li.select(F.lit("orders").alias("episode"), F.col("l_orderkey").alias("scene_id"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("speaker"), "l_linenumber", "l_partkey", "l_extendedprice")
    return network.turns(rows, ["l_linenumber", "l_partkey", "speaker", "l_extendedprice"])


def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the transcript excerpts among the documents."""
    docs = table(spark, d, "documents").where("doc_kind = 'excerpt' and text is not null").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def matched_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with speaker_ct and utterance_ct where just one speaker typed the same words in the same scene."""
    s = sentences(spark, d).withColumns({"root": T.episode_root(F.col("episode")), "norm": T.normalize_rule(F.col("utterance"))})
    typed = dialogues(spark, d).select(F.col("episode_root").alias("root"), F.col("scene_idx").alias("scene_id"), T.normalize_rule(F.col("utterance_ct")).alias("norm"), T.clean(F.col("speaker_ct")).alias("who"), "utterance_ct").where("norm <> '' and who <> ''")
    single = typed.groupBy("root", "scene_id", "norm").agg(F.min("who").alias("speaker_ct"), F.max("who").alias("_hi"), F.min("utterance_ct").alias("utterance_ct")).where("speaker_ct = _hi").drop("_hi")
    return s.join(single, ["root", "scene_id", "norm"], "left").drop("root")
