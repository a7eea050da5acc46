"""Costly work on the rows of a file of one row group is dealt over the cores."""

import pytest

from checks.base import Data

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["code_texts", "pixels"])
def test_every_core_has_rows(spark, view):
    rows = getattr(Data(spark, FOLDER), view)()
    some = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(n > 0 for n in some) >= spark.sparkContext.defaultParallelism
