"""Word boundaries next to letters beyond ASCII are the same in Spark as in the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import patterns
from quarrykit.plans.catalogue import PLAIN_PATTERNS

TEXTS = ["1234 ABé é1234 AB 1234 AB", "é1.2.3é 4.5é", "12é é34 5,6ü", "éa@b.deé .x@y.z +q@r.st- é.u@v.w", "字12字 ١2 1234xy̆", "_1_ 2_ 7", "", "1234 AB", "a * 1.* *1 x1.2"]


@pytest.mark.parametrize("name", ["postcode_nl", "number", "email", "version"])
def test_edges(spark, name):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(patterns.extract(F.col("t"), name)).collect()
    want = [duckdb.execute("SELECT regexp_extract_all(?, ?)", [t, PLAIN_PATTERNS[name]]).fetchone()[0] for t in TEXTS]
    assert [r[0] for r in got] == want
