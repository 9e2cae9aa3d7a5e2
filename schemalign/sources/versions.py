"""Publishing tables in versions: a reader sees the old one or the new one, never a part.

A version is a table of its own, bucketed by key; a view of the published name points to one. A change reads the version
at hand and writes the next one in the same buckets, so that joins and groupings by key need no exchange of the base, and
an upsert moves its updates only. The view is replaced when the version is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_TABLE, _KEYS, _BUCKETS, _EARLIER = "published.table", "published.keys", "published.buckets", "published.earlier"


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def _write(df: DataFrame, name: str, keys: Sequence[str], buckets: int, earlier: Sequence[str]) -> str:
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    told = {_TABLE: table, _KEYS: ",".join(keys), _BUCKETS: str(buckets), _EARLIER: ",".join(earlier)}
    properties = ", ".join(f"'{k}' = '{v}'" for k, v in told.items())
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({properties}) AS SELECT * FROM {table}")
    return table


def publish(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> str:
    """Write the first version of a table, or one that replaces all it held; the name of the version's own table."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    earlier = []
    if spark.catalog.tableExists(name):
        held = _properties(spark, name)
        earlier = [*filter(None, held[_EARLIER].split(",")), held[_TABLE]]
    return _write(df.repartition(buckets, *keys), name, keys, buckets, earlier)


def republish(spark: SparkSession, name: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Publish what change makes of the version at hand, such as lambda base: upsert(base, updates, keys, columns)."""
    held = _properties(spark, name)
    base = spark.table(held[_TABLE])
    earlier = [*filter(None, held[_EARLIER].split(",")), held[_TABLE]]
    return _write(change(base), name, held[_KEYS].split(","), int(held[_BUCKETS]), earlier)


def drop_versions(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Remove versions before the one at hand, but for the last `keep` of them, which readers may still be reading."""
    held = _properties(spark, name)
    earlier = [t for t in held[_EARLIER].split(",") if t]
    gone, kept = earlier[: max(len(earlier) - keep, 0)], earlier[max(len(earlier) - keep, 0) :]
    spark.sql(f"ALTER VIEW {name} SET TBLPROPERTIES ('{_EARLIER}' = '{','.join(kept)}')")
    for table in gone:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return gone
