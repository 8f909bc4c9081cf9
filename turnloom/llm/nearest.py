"""Matching records by nearest time: global range partitioning, local scans, a prefix scan over the edges.

Left and right records are range-partitioned together by (entity, time), so an entity may span any number of
tasks. Each task scans its sorted part once. What a task can't see is the last right record before and the first
one after its part; those edges, one row for each partition, go through a blocked prefix scan and close the
records left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.staging import stage
from turnloom.session import shuffle_partitions

#: Partitions of a block of the prefix scan.
SCAN_BLOCK = 64
SCHEMA = "kind string, pid int, entity string, t double, id bigint, prev_t double, prev_id bigint, next_t double, next_id bigint, open_prev boolean, open_next boolean, last_entity string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition, sorted by (entity, t, side): nearest right neighbours of each left record, and the edges."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    pid = TaskContext.get().partitionId()
    whole = pa.Table.from_batches(parts)
    codes = whole.column("entity").combine_chunks().dictionary_encode()
    names = codes.dictionary
    ent = codes.indices.to_numpy(zero_copy_only=False)
    t, ids = whole.column("t").to_numpy(), whole.column("id").to_numpy()
    right = whole.column("side").to_numpy() == 1
    n = len(t)
    at = np.arange(n)
    prev = np.maximum.accumulate(np.where(right, at, -1))
    nxt = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    left = np.flatnonzero(~right)
    if len(left):  # a record delivered twice lies beside itself
        same = np.r_[False, (ids[left][1:] == ids[left][:-1]) & (t[left][1:] == t[left][:-1]) & (ent[left][1:] == ent[left][:-1])]
        left = left[~same]
    p, q = prev[left], nxt[left]
    has_p = (p >= 0) & (ent[np.maximum(p, 0)] == ent[left])
    has_q = (q < n) & (ent[np.minimum(q, n - 1)] == ent[left])
    open_p, open_q = ~has_p & (ent[left] == ent[0]), ~has_q & (ent[left] == ent[n - 1])

    def col(values, has, kind):
        return pa.array(values, kind, mask=~has)

    sp, sq = np.maximum(p, 0), np.minimum(q, n - 1)
    m = len(left)
    rows = [pa.array(["row"] * m, pa.string()), pa.array(np.full(m, pid), pa.int32()), names.take(pa.array(ent[left])), pa.array(t[left]), pa.array(ids[left]), col(t[sp], has_p, pa.float64()), col(ids[sp], has_p, pa.int64()), col(t[sq], has_q, pa.float64()), col(ids[sq], has_q, pa.int64()), pa.array(open_p), pa.array(open_q), pa.nulls(m, pa.string())]
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    size = 50_000
    table = pa.Table.from_arrays(rows, names=fields)
    yield from table.to_batches(max_chunksize=size)
    hits = np.flatnonzero(right)
    if len(hits):
        a, b = hits[0], hits[-1]
        edge = [["edge"], [pid], [names[int(ent[a])].as_py()], [None], [None], [t[b]], [int(ids[b])], [t[a]], [int(ids[a])], [False], [False], [names[int(ent[b])].as_py()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(edge, table.schema)], names=fields)


def _edges(scanned: DataFrame, partitions: int) -> DataFrame:
    """For each partition the last right record before and the first after it: a blocked prefix scan of at most one
    row for each partition."""
    spark = scanned.sparkSession
    found = scanned.where("kind = 'edge'").select("pid", F.struct(F.col("last_entity").alias("e"), F.col("prev_t").alias("t"), F.col("prev_id").alias("id")).alias("last"), F.struct(F.col("entity").alias("e"), F.col("next_t").alias("t"), F.col("next_id").alias("id")).alias("first"))
    every = spark.range(partitions).select(F.col("id").cast("int").alias("pid"), F.floor(F.col("id") / SCAN_BLOCK).alias("blk")).join(found, "pid", "left")
    inside = W.partitionBy("blk").orderBy("pid")
    local = every.select("pid", "blk", F.last("last", True).over(inside.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(inside.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    blocks = every.groupBy("blk").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("pid"))).alias("last"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("pid"))).alias("first"))
    across = W.partitionBy(F.lit(0)).orderBy("blk")  # a row for each SCAN_BLOCK partitions
    carry = blocks.select("blk", F.last("last", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("blk_before"), F.first("first", True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("blk_after"))
    return local.join(carry, "blk").select("pid", F.coalesce("before", "blk_before").alias("before"), F.coalesce("after", "blk_after").alias("after"))


def nearest_records(left: DataFrame, right: DataFrame, tolerance: float, partitions: int | None = None) -> DataFrame:
    """Each left record with the right record of its entity nearest in time: entity, left_id, left_t, right_id, right_t, gap.

    Both inputs have entity, t and id (further columns are ignored). Only pairs at most ``tolerance`` apart come out.
    Of two right records equally far, the earlier one is taken; of several at one time, the greatest id of those before the
    left record, the least of those at its time or after. Records with null entity, t or id take part in nothing; NaN counts as
    null. A left record delivered twice comes out once; empty inputs give no rows.
    """
    spark = left.sparkSession
    n = partitions or shuffle_partitions(spark)
    sides = [df.select(F.col("entity").cast("string"), F.col("t").cast("double"), F.col("id").cast("bigint"), F.lit(k).cast("int").alias("side")) for k, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1]).where("entity is not null and t is not null and not isnan(t) and id is not null")
    ranged = both.repartitionByRange(n, "entity", "t").sortWithinPartitions("entity", "t", "side", "id")
    scanned = stage(ranged.mapInArrow(_scan, SCHEMA), "nearest")
    rows = scanned.where("kind = 'row'")
    edges = F.broadcast(_edges(scanned, n))  # never more than a row for each partition
    closed = rows.where("not open_prev and not open_next").drop("kind", "last_entity")
    opened = rows.where("open_prev or open_next").join(edges, "pid", "left")
    use_p = F.col("open_prev") & (F.col("before.e") == F.col("entity"))
    use_q = F.col("open_next") & (F.col("after.e") == F.col("entity"))
    opened = opened.select("pid", "entity", "t", "id", F.when(use_p, F.col("before.t")).otherwise(F.col("prev_t")).alias("prev_t"), F.when(use_p, F.col("before.id")).otherwise(F.col("prev_id")).alias("prev_id"), F.when(use_q, F.col("after.t")).otherwise(F.col("next_t")).alias("next_t"), F.when(use_q, F.col("after.id")).otherwise(F.col("next_id")).alias("next_id"), "open_prev", "open_next")
    whole = closed.unionByName(opened.select(*closed.columns))
    before, after = F.col("t") - F.col("prev_t"), F.col("next_t") - F.col("t")
    back = F.col("prev_t").isNotNull() & (F.col("next_t").isNull() | (before <= after))
    picked = whole.select("entity", F.col("id").alias("left_id"), F.col("t").alias("left_t"), F.when(back, F.col("prev_id")).otherwise(F.col("next_id")).alias("right_id"), F.when(back, F.col("prev_t")).otherwise(F.col("next_t")).alias("right_t"))
    gap = F.abs(F.col("left_t") - F.col("right_t"))
    return picked.withColumn("gap", gap).where(F.col("gap") <= tolerance)
