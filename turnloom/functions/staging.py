"""Staged tables in the folder shared by all executors, and size-checked lookup joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text up to which a lookup side is broadcast; beyond either the join is shuffled and salted. The driver
#: holds a broadcast several times over (rows, hash table, blocks, network buffers), beside all else in its small heap.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a private folder only where that is unset and all runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="turnloom-"))
    return _own[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: the lineage is cut, the
    rows survive the loss of any executor, and several consumers read it without recomputation.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is all in the rows: a table of few
    files is dealt out anew, one of many stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salt_by: str | None = None, salts: int = 8) -> DataFrame:
    """Join a lookup table. The lookup is measured first: up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, as
    JSON has them, it is broadcast, beyond that both sides are shuffled on the keys, the left one salted by
    ``salt_by`` so that a hot key is spread over ``salts`` tasks."""
    bytes_ = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*right.columns)))), F.lit(0)).alias("b")
    size = right.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), bytes_).collect()[0]
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    if salt_by is None:
        return left.join(right, keys, how)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
