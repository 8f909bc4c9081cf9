"""Filling containers of fixed capacity: hierarchical residual packing.

Every node packs its items best-fit in decreasing order and lets nearly full containers go. What is underfull
becomes an item of the next round, packed with that of other nodes, in a tree down to a single task. Of two containers
that can be joined one is at most half full, and best fit leaves at most one of those in a node: a round of k nodes
leads to k joins at most. So a node hands on its k emptiest containers; whatever the others could take in, those can
too, and the others are final without loss.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import stage

CAPACITY = 2048
#: Items of a node of the first round, and nodes that one node of the next round takes over.
NODE_ITEMS, FAN_IN = 1 << 16, 8
MEMBER = "struct<doc_id:bigint,piece:bigint,start:bigint,n:bigint>"
KIND = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))
BIN = f"done boolean, container_id string, fill bigint, members array<{MEMBER}>"


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(fill, item indices) of each container, by best fit in decreasing order. The residuals in use are bits of one
    integer, so the tightest container with room is its lowest bit at or above the size."""
    mask, by_rest, bins = 0, {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        room = mask >> size
        if room:
            rest = size + (room & -room).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                mask &= ~(1 << rest)
            bins[b][0] += size
            bins[b][1].append(i)
        else:
            rest, b = capacity, len(bins)
            bins.append([size, [i]])
        if not by_rest.setdefault(rest - size, []):
            mask |= 1 << (rest - size)
        by_rest[rest - size].append(b)
    return [(fill, items) for fill, items in bins]


def _round(capacity: int, enough: int, nodes: int):
    last = nodes == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, members, bare = [], [], []
        for batch in batches:
            for fill, own in zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist()):
                if fill:
                    fills.append(fill)
                    members.append(own)
                else:
                    bare += own
        bins = best_fit(fills, capacity)
        under = {i for _, i in heapq.nsmallest(nodes, ((fill, i) for i, (fill, _) in enumerate(bins) if fill < enough))} if not last else set()
        node = TaskContext.get().partitionId()
        if bare and not bins:  # nothing but items of size 0
            bins = [(0, [])]
        for k in range(0, len(bins), 1000):
            part = bins[k : k + 1000]
            done = [k + j not in under for j in range(len(part))]
            # Items of size 0 are dealt out among the containers.
            held = [[m for i in items for m in members[i]] + bare[k + j :: len(bins)] for j, (_, items) in enumerate(part)]
            yield pa.RecordBatch.from_arrays([pa.array(done), pa.array([f"{nodes}-{node}-{k + j}" for j in range(len(part))], pa.string()), pa.array([f for f, _ in part], pa.int64()), pa.array(held, KIND)], names=["done", "container_id", "fill", "members"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", size: str = "n_tokens", nearly_full: float = 0.995, node_items: int = NODE_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece, start, n) of every piece of every item: container_id names round, node and bin.

    An item longer than the capacity is cut into full pieces and one rest; nothing else is split. Items of size 0 or
    null take no room and are dealt out among the containers of their node; a node with nothing else has one of its own.
    No container exceeds the capacity, and every row of the input comes out, repeated rows as items of their own. Rows
    with null key are packed too. The number of nodes follows the number of items.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = sizes.select(F.col(key).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("bigint")))
    pieces = items.select("doc_id", "size", cuts.alias("piece")).select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n"))
    member = F.struct("doc_id", "piece", "start", "n").cast(MEMBER)
    todo = stage(pieces.select(F.col("n").alias("fill"), F.array(member).alias("members")), "items")  # counting tokens is done once
    nodes, done = max(1, -(-todo.count() // node_items)), []
    enough = max(1, int(capacity * nearly_full))
    while True:
        last = nodes == 1
        first = F.col("members")[0]
        dealt = todo.repartition(nodes, F.xxhash64(first["doc_id"], first["piece"], F.lit(nodes)))
        packed = stage(dealt.mapInArrow(_round(capacity, enough, nodes), BIN), f"pack{nodes}")
        done.append(packed.where("done"))
        if last:
            break
        todo = packed.where("not done").select("fill", "members")
        nodes = -(-nodes // FAN_IN)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("container_id", F.explode("members").alias("m")).select("container_id", "m.doc_id", "m.piece", "m.start", "m.n")
