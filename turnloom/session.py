"""Session settings and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "turnloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything in ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
