"""Dictionary and table input and output."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DICTIONARY_SCHEMA = "src string, target string, description string"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header SRC,TARGET,DESCRIPTION; rows without a source name are skipped."""
    rows = spark.read.schema(DICTIONARY_SCHEMA).csv(path, header=True, escape='"', multiLine=True)
    return rows.filter(F.coalesce("src", F.lit("")) != "")


def dictionary(spark: SparkSession, name: str) -> DataFrame:
    """The stored dictionary in target and source order; an empty one if the table cannot be read."""
    try:
        return spark.table(name).select("src", "target", "description").orderBy("target", "src")
    except AnalysisException:
        return spark.createDataFrame([], DICTIONARY_SCHEMA)


class Written(NamedTuple):
    table: str
    rows: int
    mapped_columns: int
    null_columns: int


def write_conformed(df: DataFrame, table: str, mapped_targets: Sequence[str], path: str | None = None) -> Written:
    """Create or replace the table with all target columns, at a path if one is given, and tell what was written.

    Rows are counted while they are written, not in a second pass.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    mapped = len(set(mapped_targets) & set(df.columns))
    return Written(table, seen.get["rows"], mapped, len(df.columns) - mapped)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
