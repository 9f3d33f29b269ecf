import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a column function over literal arguments."""
    from pyspark.sql import functions as F

    def run(fn, *args, kinds=None):
        kinds = kinds or ["string"] * len(args)
        cols = [F.lit(a).cast(k) for a, k in zip(args, kinds)]
        return spark.range(1).select(fn(*cols).alias("x")).first()["x"]

    return run
