"""Session settings the package relies on."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shuffle_width(spark: SparkSession) -> int:
    """Tasks of one shuffle, as configured for the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute rows that are cheap to move but dear to process.

    The explicit width keeps adaptive execution from folding a small, busy
    shuffle into one or two tasks.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)


def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join of two sides that both grow with the table, each hash-distributed by the keys.

    Spark guesses sizes from compressed files and would gather a side of hundreds of megabytes in the driver to
    broadcast it; the hint keeps both sides on the executors.
    """
    return spread(left, *keys).join(spread(right, *keys).hint("merge"), list(keys))


def shared_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder for written tables, in a place that all executors share.

    ``spark.checkpoint.dir`` names the place.  Where it is unset, the warehouse
    has a folder for it, but on a cluster only if the warehouse is no folder of
    one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        master = spark.conf.get("spark.master", "local")
        one_machine = urlparse(warehouse).scheme in ("", "file")
        if one_machine and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = warehouse.rstrip("/") + "/_written"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read from there.

    What is built on the result starts from files, so a lost executor costs
    the tasks it ran and not the steps before.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
