import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from tablereview.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def customers_csv(tmp_path_factory):
    """Five customers, one age missing."""
    path = tmp_path_factory.mktemp("csv") / "customers.csv"
    path.write_text(
        "customer_id,age,income,city,churn\n1,24,52000,Tampa,No\n2,31,68000,Miami,No\n"
        "3,45,91000,Tampa,Yes\n4,,73000,Orlando,No\n5,29,58000,Tampa,Yes\n"
    )
    return str(path)
