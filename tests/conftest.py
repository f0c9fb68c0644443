import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check_oracle import session  # noqa: E402

from gridloom.sources import workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    workspace.forget(spark)
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
