"""Tables of one small file: what is done with each row is dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from cyclaris import queries

from .helpers import DATA


@pytest.mark.parametrize("source", ["_customers", "_parts", "_lines"])
def test_rows_of_a_small_file_are_dealt_to_tasks(spark, source):
    made = getattr(queries, source)(spark, DATA)
    tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < sum(r["n"] for r in tasks)
