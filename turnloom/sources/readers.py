"""Readers of transcripts, shots, tables and graphs. Whole files become rows in the JVM; many files are one job."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.functions import text as T
from turnloom.operators import sequence

WORD = "STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, speaker: STRING>"
SENTENCE = "STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, speaker: STRING>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def _first_is_complete(records: Column, needed: Iterable[str], what: str) -> Column:
    """The records, or an error if the first one (as a map of its fields) lacks a field."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in needed]), F.map_keys(F.from_json(F.get(records, F.lit(0)), "MAP<STRING, STRING>")))
    return F.when((F.size(records) > 0) & (F.size(lacking) > 0), F.raise_error(F.concat(F.lit(f"{what} lack the fields "), F.array_join(lacking, ", ")))).otherwise(records)


def _records(spark: SparkSession, path: str, field: str, needed: Iterable[str], element: str, bare: bool) -> DataFrame:
    """file, pos, r: the records of ``{field: [...]}`` files, or of bare lists where those are allowed."""
    files = _files(spark, path)
    inside = F.get_json_object("body", f"$.{field}")
    is_list = F.ltrim("body").startswith("[")
    raw = F.from_json(F.when(is_list & F.lit(bare), F.col("body")).otherwise(inside), "ARRAY<STRING>")
    checked = F.when(raw.isNull(), F.raise_error(F.concat(F.lit(f"no list of {field} in "), F.col("file")))).otherwise(raw)
    kept = files.select("file", _first_is_complete(checked, needed, field).alias("raw"))
    each = kept.select("file", F.posexplode("raw").alias("idx", "json"))
    return each.select("file", "idx", F.from_json("json", element.removeprefix("STRUCT<").removesuffix(">").replace(": ", " ")).alias("r"))


def read_words(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Word transcripts, ``{"words": [...]}`` or a bare list: file, idx, word, start_s, end_s, speaker. A null end is
    the start; the order is that of start, then of the file. A file whose first word lacks a field is an error. With
    ``names`` speakers are title-cased and replaced by what the map has for the title-cased label."""
    r = _records(spark, path, "words", ("word", "start", "end", "speaker"), WORD, bare=True)
    return r.select("file", "idx", F.col("r.word").alias("word"), F.col("r.start").alias("start_s"), F.coalesce("r.end", "r.start").alias("end_s"), (F.col("r.speaker") if names is None else T.mapped_speaker(F.col("r.speaker"), F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair]))).alias("speaker"))


def read_utterances(spark: SparkSession, path: str, names: dict[str, str] | None = None, gap: float = 0.5) -> DataFrame:
    """Word transcripts as utterances, a speaker's words with less than ``gap`` seconds between them being one: file, idx,
    speaker, start_s, end_s, n_words, text."""
    words = read_words(spark, path, names)
    ordered = words.withColumn("idx", F.row_number().over(W.partitionBy("file").orderBy("start_s", "idx")) - 1)
    return sequence.word_sessionization(ordered, ["file"], "idx", gap)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence transcripts, ``{"sentences": [...]}``: file, idx, text, start_s, end_s, speaker. Records without text are
    left out, but the others keep their index; a missing start is 0, a missing end the start."""
    r = _records(spark, path, "sentences", (), SENTENCE, bare=False)
    start = F.coalesce("r.start", F.lit(0.0))
    return r.where(F.coalesce(T.strip(F.col("r.text")), F.lit("")) != "").select("file", "idx", F.col("r.text").alias("text"), start.alias("start_s"), F.coalesce(F.col("r.end"), start).alias("end_s"), F.coalesce("r.speaker", F.lit("")).alias("speaker"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of text files."""
    return _files(spark, path).select("file", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("line_no", "line"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """Shots of delimited files: file, shot_id, start_s, end_s. With columns onset and duration a shot's id is its row
    number, malformed rows counting; otherwise the header is looked for below a preamble and ids are read. Rows that
    don't parse are left out; a file of neither form is an error."""
    lines = read_lines(spark, path).where(F.trim("line") != "")
    first = lines.where("line_no = 0").select("file", F.when(F.contains("line", F.lit("\t")), "\t").otherwise(",").alias("sep"), F.col("line").alias("top"))
    header = lines.where(F.contains("line", F.lit("Scene Number"))).groupBy("file").agg(F.min("line_no").alias("legacy_at"), F.min_by("line", "line_no").alias("legacy_top"))
    split = lambda c: F.transform(F.split(c, ",|\t"), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    kinds = first.join(header, "file", "left")
    plain = F.array_contains(split(F.col("top")), "onset") & F.array_contains(split(F.col("top")), "duration")
    bad = ~plain & F.col("legacy_at").isNull()
    kinds = kinds.withColumn("plain", F.when(bad, F.raise_error(F.concat(F.lit("unsupported shots file "), F.col("file")))).otherwise(plain))
    names = split(F.when(F.col("plain"), F.col("top")).otherwise(F.col("legacy_top")))
    kinds = kinds.select("file", "plain", names.alias("names"), F.when(F.col("plain"), F.lit(0)).otherwise(F.col("legacy_at")).alias("header_at"))
    rows = lines.join(kinds, "file").where("line_no > header_at").withColumn("cells", split(F.col("line")))
    cell = lambda name: F.get(F.col("cells"), (F.array_position("names", name) - 1).cast("int"))
    number = lambda name: cell(name).try_cast("double")
    nth = F.row_number().over(W.partitionBy("file").orderBy("line_no"))
    out = rows.withColumn("nth", nth).select("file", F.when(F.col("plain"), F.col("nth")).otherwise(cell("Scene Number").try_cast("int")).alias("shot_id"), F.when(F.col("plain"), number("onset")).otherwise(number("Start Time (seconds)")).alias("start_s"), F.when(F.col("plain"), number("onset") + number("duration")).otherwise(number("End Time (seconds)")).alias("end_s"))
    return out.where("shot_id is not null and start_s is not null and end_s is not null")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines of typed transcripts with kind (scene or dialogue), scene_desc, speaker_ct, utterance_ct; blank lines go.

    In order: a bracketed line is a scene (a leading ``scene:`` is dropped), a parenthesised one too, and credits; a
    name of up to 80 characters before a colon speaks; any other line is a scene.
    """
    line = T.strip(F.col("line"))
    kept = lines.withColumn("_l", line).where("_l <> ''")
    spoken = kept.withColumn("_m", F.regexp_extract("_l", r"^([^:]{1,80}):\s*(.+)$", 2))
    low = F.lower("_l")
    bracket, round_ = F.col("_l").rlike(r"^\[.*\]$"), F.col("_l").rlike(r"^\(.*\)$")
    credits = low.isin("opening credits", "closing credits")
    speaks = ~bracket & ~round_ & ~credits & (F.col("_m") != "")
    inner = T.strip(F.expr("substr(_l, 2, greatest(length(_l) - 2, 0))"))
    desc = F.when(bracket, F.regexp_replace(inner, r"^(?i)\s*scene\s*:\s*", "")).when(round_, inner).otherwise(F.col("_l"))
    return spoken.withColumns({"kind": F.when(speaks, "dialogue").otherwise("scene"), "scene_desc": F.when(~speaks, desc), "speaker_ct": F.when(speaks, T.strip(F.regexp_extract("_l", r"^([^:]{1,80}):", 1))), "utterance_ct": F.when(speaks, T.strip(F.col("_m")))}).drop("_l", "_m")


def parse_transcript(lines: DataFrame, keys: list[str], pos: str = "line_no") -> DataFrame:
    """The classified lines with scene_idx, the running number of scenes, and dialogue_idx from 0. A text that opens with
    dialogue has an unnamed first scene, so its marker lines count from 2."""
    events = classify_lines(lines)
    w = W.partitionBy(*keys).orderBy(pos)
    opens = F.first("kind").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == "dialogue"
    scene = F.sum(F.when(F.col("kind") == "scene", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.when(opens, 1).otherwise(0)
    nth = F.sum(F.when(F.col("kind") == "dialogue", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return events.withColumns({"scene_idx": scene.cast("int"), "dialogue_idx": F.when(F.col("kind") == "dialogue", nth.cast("int"))})


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Typed transcript files as parsed events, one text for each file."""
    return parse_transcript(read_lines(spark, path), ["file"])


def read_table(spark: SparkSession, path: str, needed: Iterable[str] = (), sep: str = "\t", schema: str | None = None) -> DataFrame:
    """A delimited table with header, all strings unless a schema is given; doubled quotes and line breaks in quotes are
    text. Columns in ``needed`` must be there. Without a schema, what is empty is the empty string."""
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, recursiveFileLookup=True, nullValue="\u0000", emptyValue="")
    df = (reader.schema(schema) if schema else reader).csv(path)
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return df if schema else df.na.fill("")


def read_enhanced_input(spark: SparkSession, path: str) -> DataFrame:
    """Sentence tables for the fills."""
    return read_table(spark, path, ("scene_id", "sentence_id", "utterance", "speaker", "utterance_ct", "speaker_ct"))


def read_network_rows(spark: SparkSession, path: str, speaker_col: str = "speaker_ct") -> DataFrame:
    """Rows with a start, with the speaker from the chosen column and typed times; what doesn't parse is null."""
    df = read_table(spark, path).where("start is not null and trim(start) <> ''")
    speaker = F.coalesce(F.col(speaker_col), F.lit("")) if speaker_col in df.columns else F.lit("")
    return df.withColumns({"speaker": speaker, "start_s": F.col("start").try_cast("double"), "end_s": F.col("end").try_cast("double"), "scene_id": F.col("scene_id").try_cast("double").try_cast("int")})


def read_zipped_tables(spark: SparkSession, path: str, skip: str | None = "summary") -> DataFrame:
    """Tables in zip archives as bundle, name, body; names with ``skip`` in them are left out. Archives are unpacked on
    the executors, one each."""
    import io
    import zipfile

    import pandas as pd

    def unpack(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(p, n, z.read(n).decode("utf-8")) for n in sorted(z.namelist()) if n.endswith(".tsv") and not (skip and skip in n.lower())]
            yield pd.DataFrame(out, columns=["bundle", "name", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "bundle string, name string, body string")


def read_zipped_rows(spark: SparkSession, path: str, columns: tuple[str, ...], skip: str | None = "summary") -> DataFrame:
    """The rows of the tables in zip archives: bundle, name, row_no and ``columns`` as strings. Columns a table lacks are
    null, others are left out. Tables are parsed on the executors, one archive each."""
    import csv
    import io

    import pandas as pd

    def parse(batches):
        for pdf in batches:
            for bundle, name, body in zip(pdf["bundle"], pdf["name"], pdf["body"]):
                rows = [(bundle, name, i, *(r.get(c) for c in columns)) for i, r in enumerate(csv.DictReader(io.StringIO(body), delimiter="\t"))]
                yield pd.DataFrame(rows, columns=["bundle", "name", "row_no", *columns])

    return read_zipped_tables(spark, path, skip).mapInPandas(parse, ", ".join(["bundle string", "name string", "row_no bigint", *(f"`{c}` string" for c in columns)]))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lists of objects, one row for each; a file that isn't a list is an error."""
    files = _files(spark, path)
    checked = F.when(~F.ltrim("body").startswith("["), F.raise_error(F.concat(F.lit("not a list: "), F.col("file")))).otherwise(F.col("body"))
    return files.select(F.explode(F.from_json(checked, f"ARRAY<STRUCT<{_inner(schema)}>>")).alias("r")).select("r.*")


def _inner(ddl: str) -> str:
    """Top-level ``name TYPE`` of a DDL as ``name: TYPE``."""
    return re.sub(r"(^|, )(\w+) (?=[A-Z])", r"\1\2: ", ddl)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.SCENES)


def read_scene_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Temporal networks: one nested row for each scene."""
    return read_records(spark, path, schemas.SCENE_GRAPHS)


def read_speaker_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of label and name as rows: file, raw_label, canonical_name."""
    return _files(spark, path).select("file", F.explode(F.from_json("body", "MAP<STRING, STRING>")).alias("raw_label", "canonical_name"))


def read_episode_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of episode network files: episode, source, target and measures; edges with an empty end are left out, missing
    measures are 0."""
    body = "STRUCT<episode: STRING, edges: ARRAY<STRUCT<source: STRING, target: STRING, weight: DOUBLE, adjacency: DOUBLE, proximity: DOUBLE, copresence: DOUBLE>>>"
    e = _files(spark, path).select(F.from_json("body", body).alias("g")).select("g.episode", F.explode("g.edges").alias("e")).select("episode", "e.*")
    kept = e.where("coalesce(source, '') <> '' and coalesce(target, '') <> ''")
    return kept.select("episode", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("weight", "adjacency", "proximity", "copresence")])


def discover(root: str, suffixes: tuple[str, ...] = (".tsv",), prefer: tuple[str, ...] = ("final", "enhanced")) -> dict[str, Path]:
    """The best file of each episode below a folder: by the first of ``prefer`` in its path, then by name. The folder is
    walked once."""
    best: dict[str, tuple[int, str, Path]] = {}
    for p in sorted(Path(root).rglob("*")):
        if p.suffix not in suffixes or "summary" in p.name:
            continue
        m = re.match(r"(.*?s\d+e\d+[a-z]*)", p.stem.lower())
        if not m:
            continue
        rank = next((i for i, x in enumerate(prefer) if x in str(p).lower()), len(prefer))
        best[m[1]] = min(best.get(m[1], (99, "~", p)), (rank, str(p), p))
    return {k: v[2] for k, v in sorted(best.items())}
