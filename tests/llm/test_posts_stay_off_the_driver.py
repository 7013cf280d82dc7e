"""Posts of an index are joined by shuffle, however small their table looks before ``explode``."""

import pytest
from pyspark.sql import functions as F

from quarrykit.llm import common, simhash_bytes


@pytest.fixture
def eager(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(10 << 20))  # Spark's own default
    yield spark
    spark.conf.set(name, before)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_posts(eager):
    classes = common.checkpointed(eager.range(300).select(F.xxhash64("id").alias("id")))
    plan = planned(simhash_bytes.near_pairs(classes))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_blocks_of_hot_keys(eager):
    rows = common.checkpointed(eager.range(60).select((F.col("id") % 2).alias("key"), "id"))
    met = common.collision_pairs(rows, [], lambda a, b: F.lit(True), limit=7)
    plan = planned(met)
    assert plan.count("SortMergeJoin") >= 2
    assert {(r.id_a, r.id_b) for r in met.collect()} == {(a, b) for b in range(60) for a in range(b) if (a - b) % 2 == 0}
