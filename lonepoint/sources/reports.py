"""Report sinks: the ``;``-separated text form and stream outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINGLE = ("e", "n_outliers")
RK = ("e", "r", "k", "n_outliers")
RKWS = ("e", "r", "k", "w", "s", "n_outliers")


def report_lines(report: DataFrame) -> DataFrame:
    """One line per report row, in the field order of the query's kind."""
    names = set(report.columns)
    order = RKWS if "w" in names else RK if "r" in names else SINGLE
    return report.select(F.concat_ws(";", *[F.col(c).cast("string") for c in order]).alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).write.mode("overwrite").text(path)


def console_sink(stream: DataFrame, checkpoint: str, mode: str = "append"):
    """Print a streaming report until the available input is used up."""
    return (
        stream.writeStream.format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def table_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append a streaming report to parquet until the input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
