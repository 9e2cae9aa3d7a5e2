"""Rewriting sources into the target schema: every target a string column, missing ones NULL.

Many layouts at once are handled by position: rows are (source_id, values), a layout says which position of a source
feeds which target, and one job rewrites all of them, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.operators import skew
from schemalign.operators.settle import settle

# Cell texts read as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Layouts up to about this many bytes are broadcast.
BROADCAST_LAYOUTS = 50_000_000


def quoted(name: str) -> str:
    """A column reference by name, whatever characters the name has."""
    return "`" + name.replace("`", "``") + "`"


def clean_tokens(cell: Column, missing: Sequence[str] = MISSING) -> Column:
    return F.when(~cell.isin(list(missing)), cell)


def first_sources(mapping: Sequence[tuple[str, str]]) -> dict[str, str]:
    """target -> source; of several sources the first in mapping order."""
    chosen: dict[str, str] = {}
    for source, target in mapping:
        if target and target != text.IGNORED:
            chosen.setdefault(target, source)
    return chosen


def target_columns(targets: Sequence[str]) -> list[str]:
    """The targets sorted, each once; none, or two that differ in case only, are an error."""
    ordered = sorted(set(targets))
    if not ordered:
        raise ValueError("no target fields")
    folded: dict[str, str] = {}
    for target in ordered:
        if folded.setdefault(target.lower(), target) != target:
            raise ValueError(f"targets differ in case only: {folded[target.lower()]}, {target}")
    return ordered


def conform(
    df: DataFrame, mapping: Sequence[tuple[str, str]], targets: Sequence[str], missing: Sequence[str] = MISSING
) -> DataFrame:
    """One layout: a single projection onto the sorted targets, without any shuffle.

    Columns are addressed by position, so names that differ in case only are told apart; of several columns with one
    name the first counts. Targets that differ in case only cannot stand in one table and are refused.
    """
    sources = first_sources(mapping)
    if not sources:
        raise ValueError("no columns mapped")
    ordered = target_columns(targets)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = {name: i for i, name in reversed(list(enumerate(df.columns)))}

    def column(target: str) -> Column:
        at = place.get(sources.get(target))
        if at is None:
            return F.lit(None).cast("string").alias(target)
        return clean_tokens(F.col(f"c{at}").cast("string"), missing).alias(target)

    return numbered.select(*[column(target) for target in ordered])


def layouts(mapping: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(source_id, positions): for each of the sorted targets the position of the first column mapped to it, or NULL.

    One row per source with something mapped to a target.
    """
    first = (
        mapping.filter(F.col("target").isin(list(targets)) & (F.col("target") != text.IGNORED))
        .groupBy("source_id", "target")
        .agg(F.min("position").cast("int").alias("position"))
    )
    by_target = first.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "position"))).alias("m"))
    return by_target.select("source_id", F.transform(F.array(*map(F.lit, targets)), lambda t: F.try_element_at("m", t)).alias("positions"))


def conform_many(
    rows: DataFrame, mapping: DataFrame, targets: Sequence[str], missing: Sequence[str] = MISSING,
    keep: Sequence[str] = ("source_id",),
) -> DataFrame:
    """Any number of layouts in one pass; sources with nothing mapped give no rows.

    The layouts are settled first: they decide what becomes of the data and are a small fraction of it. While they are
    few they are broadcast and the rows do not move; beyond that, rows of one huge source spread over many tasks, each
    with a copy of its layout. A layout holds one number per target, so a cell is found without a search.
    """
    ordered = target_columns(targets)
    settled = settle(layouts(mapping, ordered))
    size = settled.agg(F.coalesce(F.sum(F.octet_length("source_id") + 8 * F.size("positions") + 64), F.lit(0)).alias("bytes")).first()
    if size["bytes"] <= BROADCAST_LAYOUTS:
        laid_out = rows.join(F.broadcast(settled), "source_id")
    else:
        laid_out = skew.salted_lookup(rows, settled, ["source_id"], "inner")

    def column(at: int, target: str) -> Column:
        return clean_tokens(F.get("values", F.get("positions", F.lit(at))), missing).alias(target)

    return laid_out.select(*keep, *[column(at, target) for at, target in enumerate(ordered)])


def preview(df: DataFrame, n: int, rename: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """The first n rows; rename, a list of (column, new name), also selects the columns."""
    if rename is not None:
        df = df.select(*[F.col(quoted(column)).alias(new) for column, new in rename])
    return df.limit(n)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, type, nullability, rows of the table, and how many of them are not NULL.

    One aggregation over the data; its single row is then turned into one row per column.
    """
    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(quoted(f.name))).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
                F.col(f"c{i}").alias("n_values"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counted.select("n_rows", F.inline(described))


def sample_values(df: DataFrame, order_by: str, k: int = 3, width: int = 30) -> DataFrame:
    """Per column its first k values in row order, each cut to width, as 'a, b, c...'.

    Each task keeps only its own first k values per column before the shuffle.
    """
    names = [c for c in df.columns if c != order_by]

    def cell(name: str) -> Column:
        cut = F.substring(F.col(quoted(name)).cast("string"), 1, width)
        return F.struct(F.lit(name).alias("column_name"), cut.alias("value"))

    cells = df.select(F.col(quoted(order_by)).alias("_at"), F.inline(F.array(*[cell(name) for name in names])))
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy("_at"))
    first = cells.filter(F.col("value").isNotNull()).withColumn("nth", nth).filter(F.col("nth") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "value"))), lambda v: v["value"])
    return first.groupBy("column_name").agg(F.concat(F.array_join(listed, ", "), F.lit("...")).alias("sample"))


def file_stats(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: rows, columns and format (its extension in upper case). Rows are counted before they are joined."""
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return files.join(counts, "source_id", "left").select(
        "source_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.size("columns").alias("n_columns"),
        F.upper(F.regexp_extract("source_id", r"[^.]+$", 0)).alias("format"),
    )
