"""Measures of networks: centralities, entropy, density, components, communities, edge lifetimes.

Whatever is a sum over edges is an aggregation. Betweenness, eigenvectors and communities need a whole graph at a
time; a graph there is a scene or an episode, whose size is bounded by its cast, not by the corpus.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.staging import stage

MEASURES = ("degree", "degree_weighted", "strength", "degree_unweighted", "betweenness", "eigenvector")


def ends(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge from both its ends: keys, character, other, weight."""
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))))
    return edges.select(*keys, both.alias("e"), "weight").select(*keys, F.col("e.a").alias("character"), F.col("e.b").alias("other"), "weight")


def strength_share(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """A node's weight as a share of all nodes' weight in its graph; 0 where there is no weight."""
    own = ends(edges, keys).groupBy(*keys, "character").agg(F.sum(F.round(F.col("weight") * 10000).cast("bigint")).alias("w"))
    all_of = W.partitionBy(*keys)
    joined = nodes.join(own, [*keys, "character"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    total = F.sum("w").over(all_of)
    return joined.select(*keys, "character", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("value"))


def degree_unweighted(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """A node's neighbours over all other nodes; 0 for a node alone."""
    own = ends(edges, keys).groupBy(*keys, "character").agg(F.count("*").alias("d"))
    n = F.count("*").over(W.partitionBy(*keys))
    joined = nodes.join(own, [*keys, "character"], "left").withColumn("n", n)
    return joined.select(*keys, "character", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("value"))


def graph_density(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_nodes, n_edges, density: edges over possible edges, 0 below two nodes."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    both = n.join(m, keys, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return both.withColumn("density", F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))


def interaction_entropy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy in bits of how a graph's weight is spread over its edges."""
    w = F.col("weight")
    return edges.where("weight > 0").groupBy(*keys).agg((F.log2(F.sum(w)) - F.sum(w * F.log2(w)) / F.sum(w)).alias("entropy"))


def scene_metrics(nodes: DataFrame, edges: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Size, components, density, duration, interaction edges and their density, and entropy of each scene graph."""
    real = edges.groupBy(*keys).agg(F.count_if((F.col("adjacency") > 0) | (F.col("proximity") > 0)).alias("n_interaction_edges"))
    spans = bounds.select(*keys, (F.col("end_s") - F.col("start_s")).alias("duration_s"))
    whole = graph_density(nodes, edges, keys).join(spans, keys, "left").join(real, keys, "left").join(interaction_entropy(edges, keys), keys, "left")
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    ratio = F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_interaction_edges") / possible).otherwise(0.0)
    done = stage(whole.withColumns({"n_interaction_edges": F.coalesce("n_interaction_edges", F.lit(0)), "entropy": F.coalesce("entropy", F.lit(0.0))}).withColumn("interaction_density", ratio), "scene_metrics")
    return done.join(component_counts(nodes, edges, keys, done), keys, "left")


def component_counts(nodes: DataFrame, edges: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """keys, n_components. A graph with every possible edge has one; only others are walked. ``sizes`` has n_nodes and
    n_edges of each graph, if they are known."""
    sizes = stage(graph_density(nodes, edges, keys), "sizes") if sizes is None else sizes
    full = 2 * F.col("n_edges") >= F.col("n_nodes") * (F.col("n_nodes") - 1)
    whole = sizes.where(full).select(*keys, F.lit(1).cast("bigint").alias("n_components"))
    open_ = sizes.where(~full).select(*keys)
    if open_.isEmpty():
        return whole
    walked = connected_components(nodes.join(open_, keys, "left_semi"), edges.join(open_, keys, "left_semi"), keys)
    return whole.unionByName(walked.groupBy(*keys).agg(F.countDistinct("component").alias("n_components")))


def edge_birth_death(edges: DataFrame) -> DataFrame:
    """First and last scene of each pair of an episode, and in how many it is."""
    return edges.groupBy("episode", "source", "target").agg(F.min("scene_id").alias("first_scene"), F.max("scene_id").alias("last_scene"), F.count("*").alias("n_scenes"))


def dominant_character(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The character of greatest unweighted degree in each graph; the first by name of equals."""
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("character").alias("character"))).alias("m")
    return degree_unweighted(nodes, edges, keys).groupBy(*keys).agg(best).select(*keys, F.col("m.character").alias("character"), (-F.col("m.v")).alias("value"))


def interaction_matrix(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The symmetric matrix of weights in long form: keys, row, col, weight. Pairs without an edge are zero and left out."""
    return ends(edges, keys).select(*keys, F.col("character").alias("row"), F.col("other").alias("col"), "weight")


def centrality_ranking(nodes: DataFrame, edges: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The ``n`` characters of greatest strength share of each graph, ranked; equals by name."""
    ranked = strength_share(nodes, edges, keys).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "character")))
    return ranked.where(F.col("rank") <= n)


def centrality_timeseries(nodes: DataFrame, edges: DataFrame, measures: tuple[str, ...] = ("degree", "degree_unweighted")) -> DataFrame:
    """One row for each scene, character and measure."""
    keys = ["episode", "scene_id"]
    parts = [centrality(nodes, edges, keys, m).withColumn("measure", F.lit(m)) for m in measures]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(*keys, "measure", "character", "value")


def _graph(names: list[str], links: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    graph: dict[str, dict[str, float]] = {n: {} for n in sorted(names)}
    for a, b, w in links:
        if a and b and a != b:
            graph.setdefault(a, {})[b] = w
            graph.setdefault(b, {})[a] = w
    return graph


def betweenness_of(graph: dict[str, dict[str, float]]) -> dict[str, float]:
    """Shortest paths through each node over 1 / weight, endpoints left out, as a share of all pairs of others."""
    score = dict.fromkeys(graph, 0.0)
    n = len(graph)
    for source in graph:
        dist: dict[str, float] = {}
        best, paths, via = {source: 0.0}, defaultdict(float, {source: 1.0}), defaultdict(list)
        heap, order = [(0.0, source)], []
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in graph[v].items():
                if w <= 0 or u in dist:
                    continue
                far = d + 1.0 / w
                if u not in best or far < best[u] - 1e-12:
                    best[u], paths[u], via[u] = far, paths[v], [v]
                    heapq.heappush(heap, (far, u))
                elif abs(far - best[u]) <= 1e-12:
                    paths[u] += paths[v]
                    via[u].append(v)
        part = defaultdict(float)
        for v in reversed(order):
            for u in via[v]:
                part[u] += paths[u] / paths[v] * (1.0 + part[v])
            if v != source:
                score[v] += part[v]
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: s * scale for v, s in score.items()}


def eigenvector_of(graph: dict[str, dict[str, float]], rounds: int = 1000) -> dict[str, float] | None:
    """The leading eigenvector of the weights, of length 1, by powers of (A + 1); None if it doesn't settle."""
    n = len(graph)
    x = dict.fromkeys(graph, 1.0 / n) if n else {}
    for _ in range(rounds):
        new = {v: x[v] + sum(w * x[u] for u, w in near.items()) for v, near in graph.items()}
        length = math.sqrt(sum(v * v for v in new.values())) or 1.0
        new = {k: v / length for k, v in new.items()}
        if sum(abs(new[k] - x[k]) for k in x) < n * 1e-6:
            return new
        x = new
    return None


def louvain_of(graph: dict[str, dict[str, float]], seed: int = 7) -> dict[str, int]:
    """Communities by local moves and aggregation that raise weighted modularity, in a fixed order."""
    place = {v: v for v in graph}
    level: dict[str, dict[str, float]] = {v: dict(near) for v, near in graph.items()}
    rng = random.Random(seed)
    while True:
        total = sum(sum(near.values()) for near in level.values())
        if not total:
            break
        home = {v: v for v in level}
        degree = {v: sum(near.values()) for v, near in level.items()}
        load = dict(degree)
        moved_any, moved = False, True
        order = sorted(level)
        rng.shuffle(order)
        while moved:
            moved = False
            for v in order:
                links: dict[str, float] = defaultdict(float)
                for u, w in level[v].items():
                    if u != v:
                        links[home[u]] += w
                load[home[v]] -= degree[v]
                best, gain = home[v], links[home[v]] - load[home[v]] * degree[v] / total
                for c in sorted(links):
                    g = links[c] - load[c] * degree[v] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                load[best] += degree[v]
                if best != home[v]:
                    home[v], moved, moved_any = best, True, True
        place = {v: home[c] for v, c in place.items()}
        if not moved_any:
            break
        merged: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for v, near in level.items():
            merged[home[v]]
            for u, w in near.items():
                merged[home[v]][home[u]] += w
        level = {v: dict(near) for v, near in merged.items()}
    return _numbered(place)


def components_of(graph: dict[str, dict[str, float]]) -> dict[str, str]:
    """Each node with the least name of its component."""
    found: dict[str, str] = {}
    for v in sorted(graph):
        if v in found:
            continue
        stack = [v]
        while stack:
            u = stack.pop()
            if u not in found:
                found[u] = v
                stack += graph[u]
    return found


def girvan_newman_of(graph: dict[str, dict[str, float]]) -> dict[str, int]:
    """The first split: edges of greatest unweighted edge betweenness go until there is one component more."""
    left = {v: dict(near) for v, near in graph.items()}
    start = len(set(components_of(left).values()))
    while any(left.values()):
        score: dict[tuple[str, str], float] = defaultdict(float)
        for source in left:
            paths, via, dist, order = defaultdict(float, {source: 1.0}), defaultdict(list), {source: 0}, [source]
            for v in order:
                for u in left[v]:
                    if u not in dist:
                        dist[u] = dist[v] + 1
                        order.append(u)
                    if dist[u] == dist[v] + 1:
                        paths[u] += paths[v]
                        via[u].append(v)
            part = defaultdict(float)
            for v in reversed(order):
                for u in via[v]:
                    share = paths[u] / paths[v] * (1.0 + part[v])
                    score[min(u, v), max(u, v)] += share
                    part[u] += share
        a, b = min(score, key=lambda e: (-round(score[e], 9), e))
        del left[a][b], left[b][a]
        if len(set(components_of(left).values())) > start:
            break
    return _numbered(components_of(left))


def _numbered(place: dict[str, str]) -> dict[str, int]:
    number: dict[str, int] = {}
    return {v: number.setdefault(place[v], len(number)) for v in sorted(place)}


def modularity(graph: dict[str, dict[str, float]], community: dict[str, int]) -> float:
    """Weighted modularity of a partition."""
    total = sum(sum(near.values()) for near in graph.values())
    if not total:
        return 0.0
    inside, load = 0.0, defaultdict(float)
    for v, near in graph.items():
        load[community[v]] += sum(near.values())
        inside += sum(w for u, w in near.items() if community[u] == community[v])
    return inside / total - sum((x / total) ** 2 for x in load.values())


def _per_graph(nodes: DataFrame, edges: DataFrame, keys: list[str], value: str, measure: Callable[[dict], dict]) -> DataFrame:
    """Apply a measure to each whole graph; rows are its nodes and its edges."""
    rows = nodes.select(*keys, F.col("character").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("weight")).unionByName(edges.select(*keys, "source", "target", "weight"))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf.target.isna()
        links = list(pdf.loc[~alone, ["source", "target", "weight"]].itertuples(index=False, name=None))
        found = measure(_graph(list(pdf.source) + list(pdf.target[~alone]), links))
        out = pd.DataFrame({"character": list(found), "value": list(found.values())})
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, v)
        return out

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, character string, value {value}")


def betweenness(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Betweenness of each character of each graph over distances 1 / weight."""
    return _per_graph(nodes, edges, keys, "double", betweenness_of)


def _eigen_or_share(graph: dict[str, dict[str, float]]) -> dict[str, float]:
    if not any(graph.values()):
        return dict.fromkeys(graph, 0.0)
    found = eigenvector_of(graph)
    if found is not None:
        return found
    total = sum(sum(near.values()) for near in graph.values())
    return {v: sum(near.values()) / total if total else 0.0 for v, near in graph.items()}


def eigenvector(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Eigenvector centrality; zeros without edges, strength shares where the iteration doesn't settle."""
    return _per_graph(nodes, edges, keys, "double", _eigen_or_share)


def centrality(nodes: DataFrame, edges: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """One of ``MEASURES`` for each character: keys, character, value."""
    if measure in ("degree", "degree_weighted", "strength"):
        return strength_share(nodes, edges, keys)
    if measure == "degree_unweighted":
        return degree_unweighted(nodes, edges, keys)
    if measure == "betweenness":
        return betweenness(nodes, edges, keys)
    if measure == "eigenvector":
        return eigenvector(nodes, edges, keys)
    raise ValueError(f"unknown measure {measure!r}; known are {', '.join(MEASURES)}")


def communities(nodes: DataFrame, edges: DataFrame, keys: list[str], method: str = "louvain") -> DataFrame:
    """keys, character, value: the number of its community, by ``louvain`` or ``girvan_newman``."""
    if method not in ("louvain", "girvan_newman"):
        raise ValueError(f"unknown method {method!r}")
    return _per_graph(nodes, edges, keys, "int", louvain_of if method == "louvain" else girvan_newman_of)


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, character, component: the least name of its component, for graphs that fit a task."""
    return _per_graph(nodes, edges, keys, "string", components_of).withColumnRenamed("value", "component")
