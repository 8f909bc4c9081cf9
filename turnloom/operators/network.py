"""Interaction networks: turns, adjacency, proximity, co-presence, edges of scenes and episodes.

The positions of turns come from one window over each scene, and the neighbours of a turn from the same window, so
adjacency and proximity cost no join. Weights are summed as integers (proximity in units of 1/lcm) and are thereby
independent of the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCENE = ["episode", "scene_id"]
PAIR = ["source", "target"]


def turns(rows: DataFrame, tie: list[str]) -> DataFrame:
    """Rows with a scene, a speaker and a start, numbered within their scene by start and ``tie``: episode, scene_id,
    pos, start_s, end_s, speaker. Blank speakers count as missing, a missing or NaN start leaves the row out, and a
    missing end is the start."""
    kept = rows.where("episode is not null and scene_id is not null and speaker is not null and trim(speaker) <> '' and start_s is not null and not isnan(start_s)")
    pos = F.row_number().over(W.partitionBy(*SCENE).orderBy("start_s", *tie))
    return kept.select("episode", "scene_id", pos.alias("pos"), "start_s", F.coalesce(F.nanvl("end_s", F.lit(None)), "start_s").alias("end_s"), F.trim("speaker").alias("speaker"))


def neighbours(t: DataFrame, window: int = 3) -> DataFrame:
    """Each pair of turns of different speakers at most ``window`` positions apart: scene, source, target, distance."""
    w = W.partitionBy(*SCENE).orderBy("pos")
    near = F.array(*[F.struct(F.lit(d).alias("distance"), F.lead("speaker", d).over(w).alias("other")) for d in range(1, window + 1)])
    pairs = t.withColumn("near", near).select(*SCENE, "speaker", F.explode("near").alias("n")).where("n.other is not null and n.other <> speaker")
    return pairs.select(*SCENE, F.least("speaker", "n.other").alias("source"), F.greatest("speaker", "n.other").alias("target"), "n.distance")


def adjacency_counts(t: DataFrame) -> DataFrame:
    """How often two speakers follow each other directly in a scene."""
    return neighbours(t, 1).groupBy(*SCENE, *PAIR).agg(F.count("*").alias("adjacency"))


def proximity_scores(t: DataFrame, window: int = 3) -> DataFrame:
    """Sum of 1 / distance over turns of two speakers at most ``window`` apart."""
    unit = math.lcm(*range(1, window + 1))
    parts = F.sum((F.lit(unit) / F.col("distance")).cast("bigint"))
    return neighbours(t, window).groupBy(*SCENE, *PAIR).agg((parts / unit).alias("proximity"))


def scene_nodes(t: DataFrame) -> DataFrame:
    """The distinct speakers of each scene."""
    return t.select(*SCENE, F.col("speaker").alias("character")).distinct()


def copresence_pairs(t: DataFrame) -> DataFrame:
    """Each pair of speakers of a scene, once."""
    n = scene_nodes(t)
    return n.withColumnRenamed("character", "source").join(n.withColumnRenamed("character", "target"), SCENE).where("source < target").select(*SCENE, *PAIR)


def scene_edges(t: DataFrame, window: int = 3, adjacency: float = 1.0, proximity: float = 0.5, copresence: float = 0.25) -> DataFrame:
    """Weighted edges of each scene: the three measures and their weighted sum, each rounded to four places. All pairs
    of a scene are there, as co-presence alone gives an edge; edges of no weight are left out."""
    unit = math.lcm(*range(1, window + 1))
    near = neighbours(t, window).select(*SCENE, *PAIR, F.when(F.col("distance") == 1, 1).otherwise(0).alias("a"), (F.lit(unit) / F.col("distance")).cast("bigint").alias("p"), F.lit(0).alias("c"))
    together = copresence_pairs(t).select(*SCENE, *PAIR, F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("p"), F.lit(1).alias("c"))
    summed = near.unionByName(together).groupBy(*SCENE, *PAIR).agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.max("c").alias("c"))
    weight = adjacency * F.col("a") + proximity * F.col("p") / unit + copresence * F.col("c")
    rounded = lambda c, name: F.round(c.cast("double"), 4).alias(name)
    return summed.select(*SCENE, *PAIR, rounded(weight, "weight"), rounded(F.col("a"), "adjacency"), rounded(F.col("p") / unit, "proximity"), rounded(F.col("c"), "copresence")).where("weight > 0")


def episode_edges(edges: DataFrame) -> DataFrame:
    """The scenes' rounded edges summed for each pair of an episode, in units of a ten-thousandth."""
    total = lambda c: (F.sum(F.round(F.col(c) * 10000).cast("bigint")) / 10000).alias(c)
    return edges.groupBy("episode", *PAIR).agg(*[total(c) for c in ("weight", "adjacency", "proximity", "copresence")])


def episode_edges_of(t: DataFrame, window: int = 3, adjacency: float = 1.0, proximity: float = 0.5, copresence: float = 0.25, scenes: int | None = None) -> DataFrame:
    """``episode_edges`` of ``scene_edges`` straight from the turns, for scenes with whole numbers. Co-presence, of which
    there are as many rows as pairs of speakers of a scene, isn't shuffled: each speaker carries the set of its scenes, 32 of
    them as the bits of a number, so two speakers meet in the first scene they share and the others are counted from
    the bits. What near turns add is looked up in a map of the source. Episodes of more scenes fall in parts of 32, whose
    edges are summed; a caller who knows that all numbers are from 0 to below ``scenes``, 32 at most, spares that sum, and
    any other number is then an error."""
    if scenes is not None and not 0 < scenes <= 32:
        raise ValueError(f"scenes must be from 1 to 32, not {scenes}")
    unit = math.lcm(*range(1, window + 1))
    units = lambda c: F.round(F.round(c.cast("double"), 4) * 10000).cast("bigint")
    alone = F.when(units(F.lit(copresence)) > 0, units(F.lit(copresence))).otherwise(0)
    together = F.when(alone > 0, 10000).otherwise(0)
    weighty = min(adjacency, proximity) >= 0 and copresence >= 0.0001  # each pair of a scene has a weight
    added = "wap" if weighty else "wapc"
    number = F.col("scene_id").cast("bigint")
    if scenes is not None:
        number = F.when(number.between(0, scenes - 1), number).otherwise(F.raise_error(F.concat(F.lit(f"not a scene below {scenes}: "), number.cast("string"))).cast("bigint"))
    part, at = F.shiftright(number, 5).alias("part"), number.bitwiseAND(31).cast("int").alias("at")
    group, one = ["episode", "part"], F.lit(1).cast("bigint")
    mark = lambda c: F.call_function("shiftleft", one, F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))

    summed = neighbours(t, window).groupBy(*SCENE, *PAIR).agg(F.sum(F.when(F.col("distance") == 1, 1).otherwise(0)).alias("a"), F.sum((F.lit(unit) / F.col("distance")).cast("bigint")).alias("p"))
    weight = adjacency * F.col("a") + proximity * F.col("p") / unit + F.lit(copresence)
    kept = lambda c: F.when(units(weight) > 0, c).otherwise(0)
    near = summed.select("episode", part, *PAIR, (kept(units(weight)) - alone).alias("w"), kept(units(F.col("a"))).alias("a"), kept(units(F.col("p") / unit)).alias("p"), (kept(F.lit(10000).cast("bigint")) - together).alias("c"))
    near = near.groupBy(*group, *PAIR).agg(*[F.sum(c).alias(c) for c in added])
    more = near.groupBy(*group, "source").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct(*added)))).alias("near"), F.bit_or(mark("target")).alias("marks"))

    cast = t.select("episode", part, at, "speaker").groupBy(*group, "speaker").agg(F.collect_set("at").alias("at"), F.bit_or(F.call_function("shiftleft", one, F.col("at"))).alias("bits"))
    # Targets stand in lists of 256 in the order of their names, so that only a source's own list is compared name by name.
    ranked = cast.select(*group, "speaker", "bits", F.explode("at").alias("at")).withColumn("list", F.floor((F.row_number().over(W.partitionBy(*group, "at").orderBy("speaker")) - 1) / 256))
    lists = ranked.groupBy(*group, "at", "list").agg(F.min("speaker").alias("least"), F.max("speaker").alias("most"), F.collect_list(F.struct(F.col("speaker").alias("target"), F.col("bits").alias("others"), mark("speaker").alias("mark"))).alias("targets"))
    sources = cast.withColumnRenamed("speaker", "source").join(more, [*group, "source"], "left").select(*group, "source", "bits", "near", F.coalesce("marks", F.lit(0)).alias("marks"), F.explode("at").alias("at"))
    before = F.call_function("shiftleft", one, F.col("at")) - 1
    met = sources.join(lists, [*group, "at"]).where("most > source").select("episode", "source", "bits", F.col("bits").bitwiseAND(before).alias("before"), "near", "marks", (F.col("least") > F.col("source")).alias("whole"), "targets")
    pairs = met.select("*", F.inline("targets")).where("(before & others) = 0 and (whole or target > source)")
    found = pairs.select("episode", *PAIR, F.bit_count(F.col("bits").bitwiseAND(F.col("others"))).cast("bigint").alias("n"), F.when(F.col("marks").bitwiseAND(F.col("mark")) != 0, F.try_element_at("near", F.col("target"))).alias("x"))
    add = lambda c: F.coalesce(f"x.{c}", F.lit(0).cast("bigint")) if c in added else F.lit(0).cast("bigint")
    edges = found.select("episode", *PAIR, (F.col("n") * alone + add("w")).alias("w"), add("a").alias("a"), add("p").alias("p"), (F.col("n") * together + add("c")).alias("c"))
    if scenes is None:
        edges = edges.groupBy("episode", *PAIR).agg(*[F.sum(c).alias(c) for c in "wapc"])
    total = lambda c, name: (F.col(c) / 10000).alias(name)
    if not weighty:
        edges = edges.where("w > 0")
    return edges.select("episode", *PAIR, total("w", "weight"), total("a", "adjacency"), total("p", "proximity"), total("c", "copresence"))


def scene_bounds(t: DataFrame) -> DataFrame:
    """Start, end, and sorted speakers of each scene."""
    return t.groupBy(*SCENE).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_sort(F.collect_set("speaker")).alias("nodes"))


def episode_summary(t: DataFrame) -> DataFrame:
    """Start, end and number of scenes, turns and speakers of each episode."""
    return t.groupBy("episode").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.countDistinct("scene_id").alias("n_scenes"), F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"))


def scene_graphs(t: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row for each scene: bounds, nodes and edges, edges sorted."""
    nested = edges.groupBy(*SCENE).agg(F.array_sort(F.collect_list(F.struct("source", "target", "weight", "adjacency", "proximity", "copresence"))).alias("edges"))
    return scene_bounds(t).join(nested, SCENE, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,weight:double,adjacency:double,proximity:double,copresence:double>>")))


def turns_of_events(events: DataFrame) -> DataFrame:
    """The event stream read as turns: a day is an episode, an hour a scene, a user a speaker."""
    at = F.col("ts")
    rows = events.select(F.date_format(at, "yyyy-MM-dd").alias("episode"), F.hour(at).alias("scene_id"), (F.unix_micros(at.cast("timestamp")) / 1e6).alias("start_s"), (F.unix_micros(at.cast("timestamp")) / 1e6).alias("end_s"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("speaker"), "event_id")
    return turns(rows, ["event_id"])
