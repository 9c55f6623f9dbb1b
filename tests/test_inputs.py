"""Keys of the derived tables."""

import pytest
from pyspark.sql import functions as F

from broadsheet.plans import inputs


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_page_ids_are_unique(spark, sf):
    counts = inputs.pages(spark, f"/root/testdata/sf{sf}").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("ids")).first()
    assert counts.n == counts.ids
