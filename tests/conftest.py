import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from listing_lifecycle_spark import get_spark  # noqa: E402
from listing_lifecycle_spark.sources.locations import location_dim  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests",
        master="local[4]",
        **{
            "spark__sql__shuffle__partitions": "4",
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def locations(spark):
    return location_dim(spark).cache()
