"""Power logs and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def power_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, values): the fields of each line that is not empty or a comment, single or double spaces between them.

    The header line comes along: its fields are no numbers. So do columns that folders name, as in `channel=a/`.
    """
    lines = spark.read.text(path)
    named = [c for c in lines.columns if c != "value"]
    lines = lines.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("text"), *named)
    return lines.where((F.col("text") != "") & ~F.col("text").startswith("#")).select("file", "line", F.split("text", r"\s+").alias("values"), *named)


def write_power_log(samples: DataFrame, path: str, channel: str, fields: list[str], header: str, note: str | None = None) -> None:
    """Writes samples as logs, a folder for each channel: a header, then a line for each row, its fields two spaces apart.

    A field that is NULL becomes `-`. note: a column of comments, each put before the line of its row where it is not NULL.
    """
    text = F.array_join(F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields)), "  ")
    comment = F.lit(None).cast("string") if note is None else F.concat(F.lit("# "), F.col(note))
    lines = samples.select(F.explode(F.array_compact(F.array(comment, text))).alias("text"), F.col(channel))
    heads = samples.select(channel).distinct().select(F.lit(header).alias("text"), channel)
    heads.union(lines).write.partitionBy(channel).text(path)


def frequency_table(spark: SparkSession, path: str, schema: str = "freq int, W double") -> DataFrame:
    """A table of watts by frequency; blanks around fields are dropped."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def write_frequencies(wide: DataFrame, path: str) -> str:
    """Writes a wide table as CSV with a header; returns its schema, for reading it."""
    wide.write.csv(path, header=True)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)


def long_frequencies(wide: DataFrame, freq: str = "freq") -> DataFrame:
    """(freq, config, W) from a column of watts for each configuration."""
    return wide.unpivot([freq], [c for c in wide.columns if c != freq], "config", "W")


def wide_frequencies(rows: DataFrame, configs: list[str], freq: str = "freq") -> DataFrame:
    """The way back: a column for each configuration named."""
    return rows.groupBy(freq).pivot("config", configs).agg(F.first("W"))
