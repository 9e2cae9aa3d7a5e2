"""Landing new files as they arrive: of one settled layout, or of any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schemalign.operators.conform import conform
from schemalign.operators.mapping import MAPPING_THRESHOLD
from schemalign.plans.map_files import map_files
from schemalign.sources.delimited import LINE_END, placed_lines, read_lines


def arriving(spark: SparkSession, folder: str, columns: Sequence[str], delimiter: str = ",") -> DataFrame:
    """New text files of this layout as a stream of string columns."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in columns)
    return spark.readStream.schema(schema).csv(
        folder, sep=delimiter, header=True, escape='"', multiLine=True, enforceSchema=True
    )


def land_stream(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    mapping: Sequence[tuple[str, str]],
    targets: Sequence[str],
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    delimiter: str = ",",
) -> StreamingQuery:
    """Append all files not yet landed to the table, or to parquet files at the path, and stop.

    The checkpoint remembers what was landed, so every file is landed once. Nothing is kept between files.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table or a path")
    writer = (
        conform(arriving(spark, folder, columns, delimiter), mapping, targets)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return writer.toTable(table) if table else writer.format("parquet").start(path)


def land_files(
    spark: SparkSession,
    folder: str,
    dictionary: DataFrame,
    checkpoint: str,
    path: str,
    parked: str,
    threshold: float = MAPPING_THRESHOLD,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Land all files not yet landed, whatever their layouts, and stop.

    Each file's columns are mapped by the dictionary (src, target). Rows of files that are ready go to the path, as
    (source_id, targets...); the others are parked: (source_id, delimiter, columns, reason). A batch is written under
    its number and a repeated one replaces what it wrote before, so that every file is landed once, also when a run ends
    between two writes. Read with landed(); a later dictionary may add targets.
    """

    def land(lines: DataFrame, batch_id: int) -> None:
        files, rows = read_lines(lines)
        done = map_files(files, rows, dictionary, threshold)
        done.rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        told = files.join(done.summary.select("source_id", "ready", "mapped"), "source_id", "left")
        reason = F.coalesce(
            "error", F.when(F.coalesce("mapped", F.lit(0)) == 0, "nothing mapped").when(~F.col("ready"), "a target is claimed twice")
        )
        waiting = told.select("source_id", "delimiter", "columns", reason.alias("reason")).filter("reason IS NOT NULL")
        waiting.write.mode("overwrite").parquet(f"{parked}/batch_id={batch_id}")

    stream = spark.readStream.option("lineSep", LINE_END).option("maxFilesPerTrigger", files_per_batch).text(folder)
    writer = placed_lines(stream).writeStream.foreachBatch(land)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """What land_files has written under a path, of all batches."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("batch_id")
