"""Writers: delimited tables, JSON, graphs and bundles. Tables are written by the executors; a single small file is
written where a consumer asks for one."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a result is taken to the driver to write one file.
SMALL = 100_000


def as_text(df: DataFrame) -> DataFrame:
    """All columns as strings, null as the empty string, arrays joined by commas."""
    cols = []
    for name, kind in df.dtypes:
        c = F.array_join(F.col(name).cast("array<string>"), ",") if kind.startswith("array<") else F.col(name).cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, columns: Iterable[str] | None = None, by: Iterable[str] = (), sep: str = "\t") -> None:
    """A delimited table with header, in the given columns, partitioned by ``by``."""
    wanted = df.select(*columns) if columns else df
    writer = as_text(wanted).write.mode("overwrite").options(header=True, sep=sep, quote='"', escape='"', emptyValue="")
    (writer.partitionBy(*by) if list(by) else writer).csv(path)


def write_sentence_table(mapped: DataFrame, path: str) -> None:
    """The eight columns of the sentence table; the speaker is the typed one, else the recognised one."""
    out = mapped.select("scene_id", (F.col("idx") + 1).alias("sentence_id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text").alias("utterance"), F.coalesce("speaker_ct", "speaker").alias("speaker"), "utterance_ct", "speaker_ct")
    write_table(out, path)


def write_review(rows: DataFrame, path: str) -> None:
    """The rows under review."""
    write_table(rows.where("review_flag"), path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _small(df: DataFrame) -> list:
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"over {SMALL} rows don't go into one file; write a table")
    return rows


def write_json_list(df: DataFrame, path: str) -> None:
    """One JSON list of objects, for results of up to ``SMALL`` rows."""
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in _small(df)], ensure_ascii=False, indent=2), encoding="utf-8")


def episode_documents(edges: DataFrame, nodes: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text for each episode: bounds, number of scenes, sorted nodes and edges."""
    e = edges.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("source", "target", "weight", "adjacency", "proximity", "copresence"))).alias("edges"))
    n = nodes.select("episode", "character").distinct().groupBy("episode").agg(F.array_sort(F.collect_list("character")).alias("nodes"))
    whole = summary.join(n, "episode", "left").join(e, "episode", "left")
    body = F.to_json(F.struct("episode", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "n_scenes", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), "edges"))
    return whole.select("episode", body.alias("document"))


def metrics_documents(per_scene: DataFrame, centralities: DataFrame) -> DataFrame:
    """One JSON text for each episode: the list of its scenes' measures, and measure, character and value of the whole."""
    scenes = per_scene.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("scene_id", *[c for c in per_scene.columns if c not in ("episode", "scene_id")]))).alias("per_scene"))
    by_measure = centralities.groupBy("episode", "measure").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("character", "value")))).alias("m"))
    whole = by_measure.groupBy("episode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", F.to_json("m").alias("v"))))).alias("centralities"))
    return scenes.join(whole, "episode", "left").select("episode", F.to_json(F.struct(F.col("episode").alias("episode_id"), "per_scene", F.col("centralities").alias("episode"))).alias("document"))


def node_link(edges: DataFrame) -> dict:
    """A graph of up to ``SMALL`` edges as nodes and links."""
    rows = [r.asDict() for r in _small(edges.select("source", "target", "weight", "adjacency", "proximity", "copresence").orderBy("source", "target"))]
    return {"directed": False, "multigraph": False, "nodes": [{"id": n} for n in sorted({r[k] for r in rows for k in ("source", "target")})], "links": rows}


def write_gexf(edges: DataFrame, path: str) -> None:
    """A graph of up to ``SMALL`` edges as GEXF."""
    graph = node_link(edges)
    top = ElementTree.Element("gexf", xmlns="http://www.gexf.net/1.2draft", version="1.2")
    g = ElementTree.SubElement(top, "graph", defaultedgetype="undirected", mode="static")
    kinds = ElementTree.SubElement(g, "attributes", {"class": "edge"})
    measures = ("adjacency", "proximity", "copresence")
    for i, m in enumerate(measures):
        ElementTree.SubElement(kinds, "attribute", id=str(i), title=m, type="double")
    nodes = ElementTree.SubElement(g, "nodes")
    for n in graph["nodes"]:
        ElementTree.SubElement(nodes, "node", id=n["id"], label=n["id"])
    links = ElementTree.SubElement(g, "edges")
    for i, e in enumerate(graph["links"]):
        x = ElementTree.SubElement(links, "edge", id=str(i), source=e["source"], target=e["target"], weight=str(e["weight"]))
        values = ElementTree.SubElement(x, "attvalues")
        for k, m in enumerate(measures):
            ElementTree.SubElement(values, "attvalue", {"for": str(k), "value": str(e[m])})
    ElementTree.ElementTree(top).write(path, encoding="utf-8", xml_declaration=True)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """A table, if there is anything to write."""
    if df.isEmpty():
        return False
    write_table(df, path)
    return True


def zip_files(archive: str, files: Iterable[Path], name: Callable[[Path], str] = lambda p: p.name) -> None:
    """Files in one compressed archive."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, name(f))
