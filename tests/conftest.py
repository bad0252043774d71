import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailwarden.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def mail(spark):
    """Build a canonical-like table from dicts."""
    columns = ["sample_id", "dataset_id", "subject", "body", "sender", "receiver", "label"]
    schema = ", ".join(f"{c} {'int' if c == 'label' else 'string'}" for c in columns)

    def make(*rows):
        return spark.createDataFrame(
            [tuple(r.get(c, {"sample_id": f"s{i:03d}", "dataset_id": "a"}.get(c)) for c in columns)
             for i, r in enumerate(rows)], schema)
    return make
