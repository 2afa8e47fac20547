"""Stored tables end a lineage and can be removed."""

import os

from joblattice.llm import common


def test_stored_and_discarded(spark):
    rows = spark.range(5).selectExpr("id", "cast(null as string) text")
    back = common.stored(rows, "test-table")
    path = back.stored_at.removeprefix("file://")
    assert os.path.isdir(path) and back.schema.names == ["id", "text"]
    assert sorted(r.id for r in back.collect()) == list(range(5))
    common.discard(back)
    assert not os.path.exists(path)
