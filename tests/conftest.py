import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from heddle.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluates column expressions over one row per input string."""

    def run(function, inputs, kind="string"):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        from pyspark.sql import functions as F

        return [r[1] for r in sorted(rows.select("i", function(F.col("x")).alias("y")).collect())]

    return run
