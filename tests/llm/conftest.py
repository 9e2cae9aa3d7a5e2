from __future__ import annotations

import pytest


@pytest.fixture
def rows(spark):
    """A DataFrame of rows over two partitions."""

    def make(values, schema):
        return spark.createDataFrame(values, schema).repartition(2)

    return make
