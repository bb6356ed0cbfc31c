from __future__ import annotations

import pytest
from pyspark.sql import types as T

from fleetgauge.llm.common import ready

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def shipped(spark):
    ready(spark)
    return spark


@pytest.fixture
def documents(shipped):
    """documents((id, text) or (id, text, lang), ..., clash=names): a documents table; clashing columns are strings."""

    def build(*rows, clash=(), parts=3):
        schema = T.StructType([*DOCUMENTS, *(T.StructField(c, T.StringType()) for c in clash)])
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), *(f"{c}!" for c in clash)) for r in rows
        ]
        return shipped.createDataFrame(full, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def small(shipped):
    """The documents of the smallest data, as a table and as rows."""
    table = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return table, table.collect()
