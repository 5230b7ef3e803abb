"""The driver contract: registered queries, their checks, and the flagship query."""

import __spark_entry__ as entry


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["site_id", "name", "cells", "contested", "share"]
    assert sum(r.cells for r in df.collect()) <= 150
