"""Command line: the stages over folders of files and tables."""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.staging import stage
from turnloom.operators import impute, network, qa, sequence
from turnloom.plans import pipeline
from turnloom.session import build_session
from turnloom.sources import readers, sinks

STAGES = ("extract", "fill", "network", "analyze")
KEY = r"([^/]*?s\d+e\d+[a-z]*)[^/]*$"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnloom", description=__doc__)
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="stage", required=True)
    texts = {"extract": "speakers and scenes of sentence transcripts from typed ones", "fill": "fill missing speakers of sentence tables, and check them", "network": "build networks of filled tables", "analyze": "measure the networks", "all": "all stages that have input, in order"}
    for name, text in texts.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("--input", required=True, help="folder of delimited tables; for extract, of sentence transcripts (JSON)")
        p.add_argument("--lines", help="folder of typed transcripts, for extract")
        p.add_argument("--shots", help="folder of shot tables, for the scene summary of extract")
        p.add_argument("--output", required=True)
        p.add_argument("--episodes", nargs="*", help="only these")
        p.add_argument("--season", help="only this season, as s1 or 1")
        p.add_argument("--min-similarity", type=float, default=0.52)
        p.add_argument("--length-ratio-cap", type=float, default=5.0)
        p.add_argument("--rules", help="YAML file of markers and scores")
        p.add_argument("--speaker-col", default="speaker")
        p.add_argument("--exclude-speakers", nargs="*", default=())
        p.add_argument("--proximity-window", type=int, default=3)
        for w, v in (("adjacency", 1.0), ("proximity", 0.5), ("copresence", 0.25)):
            p.add_argument(f"--{w}-weight", type=float, default=v)
        p.add_argument("--measures", default="degree,degree_unweighted,betweenness,eigenvector")
        p.add_argument("--community-method", choices=("louvain", "girvan_newman"), default="louvain")
        p.add_argument("--skip-qa", action="store_true")
        p.add_argument("--skip-stages", nargs="*", choices=STAGES, default=(), help="stages that ``all`` leaves out")
    return top


def season_key(text: str) -> str:
    """``s1`` of s1, S01 or 1; anything else is an error."""
    m = re.fullmatch(r"s?0*(\d+)", text.strip().lower())
    if not m:
        raise ValueError(f"not a season: {text!r}")
    return f"s{m[1]}"


def _chosen(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    if a.episodes:
        rows = rows.where(F.col("episode").isin(*[e.lower() for e in a.episodes]))
    return rows.where(T.season_of(F.col("episode")) == season_key(a.season)) if a.season else rows


def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sentence tables with what the typed lines say, their scene summary, and the counts of each step."""
    episode = F.lower(F.regexp_extract("file", KEY, 1))
    s = _chosen(readers.read_sentences(spark, a.input).withColumn("episode", episode), a).withColumn("root", T.episode_root(F.col("episode")))
    events = readers.read_transcripts(spark, a.lines).withColumn("root", T.episode_root(F.regexp_extract("file", KEY, 1)))
    lines = events.where("kind = 'dialogue'").select("root", F.col("dialogue_idx").cast("bigint").alias("idx"), "scene_idx", "speaker_ct", "utterance_ct")
    found = stage(pipeline.extract_annotations(s.drop("file"), lines, ["root"], ["episode"], a.min_similarity, a.length_ratio_cap), "extracted")
    out = found.select("episode", "scene_id", (F.col("idx") + 1).alias("sentence_id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text").alias("utterance"), F.coalesce("speaker_ct", "speaker").alias("speaker"), "utterance_ct", "speaker_ct")
    sinks.write_table(out, f"{a.output}/sentences", by=["episode"])
    sinks.write_table(pipeline.annotation_stats(found, ["episode"]), f"{a.output}/annotation_stats")
    if a.shots:
        shots = readers.read_shots(spark, a.shots).withColumn("episode", F.lower(F.regexp_extract("file", KEY, 1))).drop("file")
        spoken = found.select("episode", "scene_id", F.col("idx").alias("sentence_id"), F.concat_ws("#", "episode", "idx").alias("sent_id"), "start_s", "end_s", F.coalesce("speaker_ct", "speaker").alias("speaker"))
        sinks.write_table(sequence.scene_summary(spoken, shots), f"{a.output}/scene_summary")
    return out


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sentence_id": F.col("sentence_id").try_cast("int"), "scene_id": F.col("scene_id").try_cast("double").try_cast("int"), "start_s": F.col("start").try_cast("double"), "end_s": F.col("end").try_cast("double")})


def fill(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Filled rows and reviews; then, unless skipped, the corrected rows with log, summary of files and rollup."""
    rules = impute.Rules.from_yaml(a.rules) if a.rules else impute.Rules()
    key, pos = ["episode"], "sentence_id"
    rows = stage(impute.scene_context(pipeline.fill_speakers(rows, key, pos, rules), key, pos), "enhanced")
    enhanced = impute.complete_schema(rows, ("episode", "start", "end"))
    sinks.write_table(enhanced, f"{a.output}/enhanced", by=["episode"])
    sinks.write_review(enhanced, f"{a.output}/review")
    sinks.write_table(impute.fill_summary(rows, key), f"{a.output}/fill_summary")
    if not a.skip_qa:
        before = rows
        done, logs = pipeline.check_quality(before, key, pos)
        done = stage(done.drop("prev_speaker_scene", "next_speaker_scene", "scene_speaker_set"), "checked")
        log = logs[0].unionByName(logs[1])
        files = stage(qa.summary(before, done, log, key), "qa_summary")
        rows = impute.scene_context(done, key, pos)
        sinks.write_table(impute.complete_schema(rows, ("episode", "start", "end")), f"{a.output}/final_cleaned", by=["episode"])
        for name, df in (("qa_changes", log), ("qa_summary", files), ("qa_rollup", qa.summary_rollup(files))):
            sinks.write_table(df, f"{a.output}/{name}")
    return rows


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session(a.master)
    run = [s for s in STAGES if s not in a.skip_stages] if a.stage == "all" else [a.stage]
    if "extract" in run and not a.lines:
        if a.stage == "extract":
            raise ValueError("extract needs --lines")
        run.remove("extract")
    if "extract" in run:
        rows = extract(spark, a)
        if run == ["extract"]:
            return
        rows = _typed(rows.na.fill(""))
    else:
        raw = readers.read_table(spark, a.input)
        named = raw if "episode" in raw.columns else raw.withColumn("episode", F.regexp_extract(F.col("_metadata.file_path"), KEY, 1))
        rows = _chosen(_typed(named), a)
    if "fill" in run:
        rows = fill(rows, a)
    if "network" in run or "analyze" in run:
        chosen = rows.withColumn("speaker", F.col(a.speaker_col)) if a.speaker_col != "speaker" else rows
        net = pipeline.build_network(chosen, ["sentence_id"], a.proximity_window, a.adjacency_weight, a.proximity_weight, a.copresence_weight, tuple(a.exclude_speakers))
        net = {k: stage(v, k) for k, v in net.items()}
        for name in ("scene_edges", "episode_edges"):
            sinks.write_table(net[name], f"{a.output}/{name}")
        sinks.write_json_lines(network.scene_graphs(net["turns"], net["scene_edges"]), f"{a.output}/temporal_network")
        sinks.write_json_lines(sinks.episode_documents(net["episode_edges"], net["nodes"], network.episode_summary(net["turns"])), f"{a.output}/episode_network")
        if "analyze" in run:
            found = pipeline.analyse(net, tuple(a.measures.split(",")), a.community_method)
            for name, df in found.items():
                sinks.write_unless_empty(df, f"{a.output}/{name}")
            sinks.write_json_lines(sinks.metrics_documents(found["scene_metrics"], found["episode_centrality"]), f"{a.output}/metrics")


if __name__ == "__main__":
    main()
