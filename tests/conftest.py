import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemetra.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="telemetra-tests")
    yield s


@pytest.fixture
def payloads(spark):
    """Build a payload DataFrame (seq, raw) from literal JSON texts."""

    def make(*raws):
        return spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "seq bigint, raw string")

    return make


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
