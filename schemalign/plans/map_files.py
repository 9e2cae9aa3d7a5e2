"""From files of any layout to the target schema: match headers, settle the mapping, rewrite the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemalign.operators.conform import conform_many
from schemalign.operators.dictionary import distinct_targets
from schemalign.operators.mapping import MAPPING_THRESHOLD, auto_map, mapping_summary, select_mapping
from schemalign.operators.settle import settle
from schemalign.sources.delimited import columns_of


@dataclass(frozen=True)
class MappedFiles:
    mapping: DataFrame
    summary: DataFrame
    rows: DataFrame


def map_files(
    files: DataFrame, rows: DataFrame, dictionary: DataFrame, threshold: float = MAPPING_THRESHOLD
) -> MappedFiles:
    """The mapping of every file, its summary, and the rows of the files that are ready in the target schema.

    A file is ready when something is mapped and no target is claimed twice; the others wait for review. The names
    of the target columns come to the driver, as they are the schema of the result.
    """
    columns = columns_of(files)
    targets = distinct_targets(dictionary)
    mapping = settle(select_mapping(columns, auto_map(columns, dictionary, threshold), targets, threshold))
    summary = mapping_summary(mapping)
    ready = mapping.join(summary.filter("ready").select("source_id"), "source_id", "left_semi")
    names = [r["target"] for r in targets.collect()]
    if not names:
        raise ValueError("no target fields")
    return MappedFiles(mapping, summary, conform_many(rows, ready, names))


def reviewed(mapping: DataFrame, choices: DataFrame) -> DataFrame:
    """The mapping after review: choices (source_id, src_col, target) replace what was selected."""
    chosen = choices.select("source_id", "src_col", F.col("target").alias("choice"))
    return mapping.join(chosen, ["source_id", "src_col"], "left").select(
        *[F.coalesce("choice", "target").alias("target") if c == "target" else F.col(c) for c in mapping.columns]
    )
