"""Cutting lineage: write an intermediate relation to the shared folder once and read it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local session without one gets a folder of its own."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="schemalign-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_SETTING, folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name of its own under the shared folder, which drop_settled removes with what was settled."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute df now, once, into files that outlive any executor, and go on from those."""
    spark = df.sparkSession
    path = new_folder(spark, "schemalign")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> int:
    """Remove the files settled by this program so far, once the results made from them are written; how many places there were.

    DataFrames that still read them fail afterwards.
    """
    paths, _written[:] = _written[:], []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
