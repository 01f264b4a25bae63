import datetime as dt

import pytest

from tablegauge.params import ScanParams
from tablegauge.session import local_session
from tablegauge.sources.schemas import INPUTS

SMALL = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 31, 12, 30)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params():
    return ScanParams(str(NOW))


@pytest.fixture(scope="session")
def rows(spark):
    """Build an input relation from dicts; columns left out are NULL."""
    def build(relation, *records):
        schema = INPUTS[relation]
        data = [tuple(r.get(f) for f in schema.fieldNames()) for r in records]
        return spark.createDataFrame(data, schema)
    return build


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate an expression of column ``v`` for each value."""
    def evaluate(make, items, kind="double"):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        result = frame.select("i", make(frame["v"]).alias("r")).orderBy("i").collect()
        return [row.r for row in result]
    return evaluate
