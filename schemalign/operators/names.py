"""Lists of names to be matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_inputs(df: DataFrame, names: str = "input_fields") -> DataFrame:
    """One row per requested name, in order; names asked twice stay twice."""
    others = [c for c in df.columns if c != names]
    return df.select(*others, F.posexplode(names).alias("pos", "input_field"))


def parse_name_list(df: DataFrame, text_col: str, manual: Sequence[str] = (), id_col: str = "list_id") -> DataFrame:
    """Names typed one per line plus manual ones: trimmed, blanks dropped, first occurrences in order.

    (id_col, pos, input_field), pos counting from 0 before repeats are dropped.
    """
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    names = F.concat(lines, F.array(*[F.lit(m) for m in manual]).cast("array<string>"))
    return (
        df.select(id_col, F.posexplode(names).alias("pos", "input_field"))
        .groupBy(id_col, "input_field")
        .agg(F.min("pos").alias("pos"))
    )
