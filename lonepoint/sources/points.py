"""Point sources: text lines, tables, samples.

A point frame has the columns ``id bigint`` and ``value array<double>``.  Ids
are unique and not negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_points(lines: DataFrame, column: str = "value", permissive: bool = False) -> DataFrame:
    """Points from lines ``id&v1,v2,...``; fields after a second ``&`` are ignored.

    A line that does not parse stops the job, or is dropped if ``permissive``.
    """
    fields = F.split(F.col(column), "&")
    numbers = F.split(F.regexp_replace(F.get(fields, F.lit(1)), ",+$", ""), ",")
    parsed = lines.select(
        F.col(column).alias("line"),
        F.trim(F.get(fields, F.lit(0))).try_cast("bigint").alias("id"),
        F.transform(numbers, lambda s: F.trim(s).try_cast("double")).alias("value"),
    )
    good = (
        F.col("id").isNotNull()
        & F.coalesce(F.size("value") > 0, F.lit(False))
        & F.coalesce(F.forall("value", lambda x: x.isNotNull()), F.lit(False))
    )
    if permissive:
        return parsed.where(good).select("id", "value")
    message = F.concat(F.lit("not a point line: "), F.coalesce("line", F.lit("null")))
    return parsed.select(
        F.when(good, F.col("id")).otherwise(F.raise_error(message).cast("bigint")).alias("id"),
        F.when(good, F.col("value")).otherwise(F.raise_error(message).cast("array<double>")).alias("value"),
    )


def format_points(points: DataFrame) -> DataFrame:
    """The text form of points, as one ``value`` column."""
    return points.select(
        F.concat_ws(
            "&",
            F.col("id").cast("string"),
            F.array_join(F.transform("value", lambda x: x.cast("string")), ","),
        ).alias("value")
    )


def read_text_points(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    return parse_points(spark.read.text(path), permissive=permissive)


def stream_text_points(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, permissive: bool = False
) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_points(reader.text(path), permissive=permissive)


def points_from_table(
    table: DataFrame, id_col: str, columns: Sequence[str | Column] | None = None, array_col: str | None = None
) -> DataFrame:
    """Points from a table's number columns, or from one array column."""
    if (columns is None) == (array_col is None):
        raise ValueError("give either columns or array_col")
    if array_col is not None:
        value = F.col(array_col)
    else:
        value = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    return table.select(F.col(id_col).cast("bigint").alias("id"), value.cast("array<double>").alias("value"))


def stream_table_points(
    spark: SparkSession,
    path: str,
    schema: str,
    id_col: str,
    columns: Sequence[str | Column] | None = None,
    array_col: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Points from parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return points_from_table(reader.parquet(path), id_col, columns, array_col)


def sample_head(points: DataFrame, n: int = 10_000) -> DataFrame:
    """The n points with the smallest ids."""
    return points.orderBy("id").limit(n)


def sample_random(points: DataFrame, n: int = 10_000, seed: int = 1) -> DataFrame:
    """Exactly n points (or all, if fewer), the same ones for the same seed: the smallest hashes of their ids."""
    return points.orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n)


def duplicate_ids(points: DataFrame) -> DataFrame:
    """Ids that occur more than once; empty for a valid point frame."""
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
