"""Near-duplicate vectors by lattice hashing.

Every table projects the vectors to eight dimensions by a random orthonormal map and decodes the result to the nearest
point of the E8 lattice; the cells of the nearest few of that point's 240 neighbours are probed, too. Vectors that have a
cell in common in any table are compared by cosine in double precision. With the default scale, 3 probed neighbours and
4 tables, two vectors right at a threshold of 0.93 meet with a probability above 0.999, closer ones surely enough.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemalign.llm.blocks import BLOCK_ROWS, in_cells, lowest_reachable, read_cells
from schemalign.llm.components import components
from schemalign.llm.lookups import looked_up, named_by
from schemalign.operators.settle import settle

TABLES = 4
PROBES = 3
# Cell scale as a multiple of the length to which projection shortens the distance at the threshold.
SCALE = 1.9
SEED = 20


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [
        [s if k == i else t if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for s in (1.0, -1.0)
        for t in (1.0, -1.0)
    ]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and on an odd sum round the worst coordinate the other way."""
    near = np.rint(x)
    error = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by a half: the closer of the two nearest points."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def probed_cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(vectors, 1 + probes, 8): every vector's cell and the nearest cells next to it."""
    own = nearest_e8(x)
    if not probes:
        return own[:, None]
    gain = (x - own) @ ROOTS.T
    nearest = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
    return np.concatenate([own[:, None], own[:, None] + ROOTS[nearest]], axis=1)


def _projection(dims: int, table: int) -> np.ndarray:
    basis, _ = np.linalg.qr(np.random.default_rng([SEED, table, dims]).normal(size=(max(dims, 8), 8)))
    return basis[:dims]


def cell_keys(unit: np.ndarray, threshold: float, tables: int, probes: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) numbers of cells; coordinates are halves, and few as the vectors have length 1."""
    dims = unit.shape[1]
    scale = SCALE * np.sqrt(max(2 - 2 * threshold, 1e-12) * 8 / max(dims, 8))
    weights = np.array([(2 * int(8 / scale) + 257) ** k for k in range(8)], dtype=object)
    weights = np.array([int(w) % 2**61 for w in weights], np.int64)
    keys = [
        (2 * probed_cells(unit @ _projection(dims, t) / scale, probes)).astype(np.int64) @ weights for t in range(tables)
    ]
    return np.stack(keys, axis=1)


def _usable(embedding: str) -> F.Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is taken out first, so nothing overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(nodes: DataFrame, threshold: float, tables: int, probes: int) -> DataFrame:
    """nodes (node, label, embedding, copies) -> (node, label, copies, dims, wide, vector, cells, keys): one row for each.

    Vectors go along as bytes, in the precision they are given in; cells are the keys as bytes.
    """
    kind = "<f4" if nodes.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, same in frame.groupby(frame["embedding"].map(len)):
                x = np.stack(same["embedding"].to_numpy()).astype(kind)
                found = cell_keys(_unit(x), threshold, tables, probes).reshape(len(same), -1).astype("<i8")
                packed = {"vector": [v.tobytes() for v in x], "cells": [c.tobytes() for c in found], "keys": list(found)}
                yield same[["node", "label", "copies"]].assign(dims=dims, wide=kind == "<f8", **packed)

    fields = "node long, label string, copies long, dims int, wide boolean, vector binary, cells binary, keys array<long>"
    return nodes.select("node", "label", "embedding", "copies").mapInPandas(keys, fields)


def _cells(packed: DataFrame, probes: int, block_rows: int) -> DataFrame:
    """The cells of the nodes, found by their keys alone, and then what is compared there."""
    keyed = packed.select("node", "label", "dims", F.posexplode("keys").alias("at", "key"))
    keyed = keyed.withColumn("table", F.floor(F.col("at") / (1 + probes)).cast("int")).drop("at")
    cells = in_cells(keyed, ["label", "dims", "table", "key"], "node", block_rows).drop("label", "dims")
    return cells.join(packed.select("node", "copies", "wide", "vector", "cells"), "node")


def _compare(threshold: float, tables: int):
    """Of whole cells: per node the copies linked to it that have no cell of an earlier place in common, and a forest."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, cell in frame.groupby("cell", sort=False):
            kind = "<f8" if cell["wide"].iloc[0] else "<f4"
            unit = _unit(np.frombuffer(b"".join(cell["vector"]), kind).reshape(len(cell), -1))
            copies = cell["copies"].to_numpy()
            hit = unit @ unit.T >= threshold
            np.fill_diagonal(hit, False)
            side, nodes = cell["side"].to_numpy(), cell["node"].to_numpy()
            if not cell["whole"].iloc[0]:
                hit &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(hit))
            if not len(a):
                continue
            table, key = int(cell["table"].iloc[0]), int(cell["key"].iloc[0])
            cells = np.frombuffer(b"".join(cell["cells"]), "<i8").reshape(len(cell), tables, -1)
            a, b = _first_met(cells, a, b, table, key)
            low = lowest_reachable(len(cell), a, b)
            linked = np.bincount(a, copies[b], len(cell)) + np.bincount(b, copies[a], len(cell))
            own = np.flatnonzero(linked > 0)
            parts.append(pd.DataFrame({"a": nodes[own], "b": nodes[low[own]], "linked": linked[own].astype(np.int64)}))
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "linked": []}).astype("int64")

    return links


def _first_met(cells: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that met in this table and cell, those that met nowhere before: in no earlier table, under no lower key."""
    first = np.ones(len(a), bool)
    for start in range(0, len(a), 65_536):
        x, y = cells[a[start : start + 65_536]], cells[b[start : start + 65_536]]
        met = np.zeros(len(x), bool)
        for t in range(table):
            met |= (x[:, t, :, None] == y[:, t, None, :]).any(axis=(1, 2))
        here = (x[:, table, :, None] == y[:, table, None, :]).any(axis=2) & (x[:, table] < key)
        first[start : start + 65_536] = ~(met | here.any(axis=1))
    return a[first], b[first]


def _numbers(vectors: DataFrame) -> F.Column:
    """The vectors as floats where they are floats, as doubles otherwise."""
    floats = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    return F.col("embedding").cast("array<float>" if floats else "array<double>")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    tables: int = TABLES,
    probes: int = PROBES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), one row per row.

    Vectors with equal labels are linked if their cosine is at least the threshold. Vectors that are null, zero, or hold
    null or non-finite components link with nothing, nor do those without label or those of unlike length. Equal
    vectors of one label are one node: their copies are counted, not paired. Rows that repeat a vec_id are vectors of
    their own. An empty table gives an empty result; other columns are not looked at.
    """
    own = vectors.select("vec_id", F.col("label").cast("string").alias("label"), _numbers(vectors).alias("embedding")).withColumn(
        "usable", _usable("embedding") & F.col("label").isNotNull()
    )
    usable = settle(own.filter("usable").drop("usable"))
    kinds = ["label", "embedding"]
    nodes = settle(usable.groupBy(*kinds).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    cells = _cells(settle(_packed(nodes, threshold, tables, probes)), probes, block_rows)
    met = settle(read_cells(cells, _compare(threshold, tables), "a long, b long, linked long"))
    linked = met.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    groups = components(met.select("a", "b"))
    members = (
        nodes.join(linked, "node", "left")
        .join(groups, "node", "left")
        .select(
            *kinds,
            "first_id",
            F.coalesce("component", "node").alias("component"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    named = settle(members.groupBy("component").agg(F.min("first_id").alias("component_id")))
    lookup = named_by(members, named, ["component"]).select(*kinds, "n_links", "component_id")
    counts = nodes.select(*kinds, F.col("copies").alias("rows"))
    found = looked_up(usable, lookup, kinds, counts).select("vec_id", "n_links", "component_id")
    alone = own.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
