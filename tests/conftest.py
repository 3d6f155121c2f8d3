import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[8]", 4, memory="8g", **{"spark.default.parallelism": "2"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Values of expressions over a single text."""
    from pyspark.sql import functions as F

    def value(fn, *texts):
        df = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
        return df.select(fn(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]

    return value
