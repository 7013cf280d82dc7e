import pytest

from quarrykit.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
