"""Meeting the members of one key in cells of bounded size, whatever the key's size.

A key with n members becomes ceil(n / block_rows) blocks; every pair of blocks is one cell, so each pair of members meets
in exactly one cell, no cell holds more than about two blocks, and a member is copied once per block of its key. Nothing
is emitted per pair: the function that reads a cell returns counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up
from schemalign.operators.settle import settle

BLOCK_ROWS = 512


def in_cells(rows: DataFrame, keys: Sequence[str], member: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows -> rows and (cell long, side boolean, whole boolean), without members that are alone under their key.

    A cell of two blocks has whole = False: only members of unlike side are to be compared there.
    """
    counts = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    parts = counts.select(*keys, F.ceil(F.col("rows") / block_rows).cast("int").alias("_parts"))
    met = (
        looked_up(rows, parts, keys, counts)
        .withColumn("_own", F.pmod(F.xxhash64(F.lit("block"), member), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    )
    ends = [F.least("_own", "_other"), F.greatest("_own", "_other")]
    return met.select(
        *rows.columns,
        F.xxhash64(*keys, *ends).alias("cell"),
        (F.col("_own") > F.col("_other")).alias("side"),
        (F.col("_own") == F.col("_other")).alias("whole"),
    )


def read_cells(cells: DataFrame, compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Give compare frames that hold whole cells, in order of cell; what it returns is put together.

    Cells are spread over tasks by their number and read as a stream: a task holds one batch and one cell at a time.
    """

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cell = frame["cell"].to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield compare(frame.iloc[:last])
            held = frame.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield compare(held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(stream, schema)


def lowest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a[i] - b[i]: every node's smallest reachable node."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    return label
