"""Rows of models are worked out of the tables once."""

import os

import pytest

from zephyrlake.plans import queries_models

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_tables_are_read_once(spark):
    rows = queries_models.model_rows(spark, SF)
    assert not [f for f in rows.inputFiles() if f.endswith(("events.parquet", "lineitem.parquet"))]
    want = sorted(map(str, queries_models.derived_rows(spark, SF).collect()))
    assert want and sorted(map(str, rows.collect())) == want
