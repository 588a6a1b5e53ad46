import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kickline.session import build_session
    return build_session("local[8]", shuffle_partitions=4, driver_memory="8g")


@pytest.fixture
def tiny_blocks(spark):
    """Every key with more than a handful of rows takes the hot-key path."""
    from kickline.operators.blocks import ROWS_PER_BLOCK
    spark.conf.set(ROWS_PER_BLOCK, "7")
    yield spark
    spark.conf.unset(ROWS_PER_BLOCK)
