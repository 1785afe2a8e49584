import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablekeep.session import local_session, scratch_folder  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("shared")
    session = local_session(  # tasks may be run again, as on a cluster
        "8,4", "tablekeep-tests", spark__sql__warehouse__dir=str(base / "warehouse")
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def root(spark):
    return scratch_folder(spark, "test")


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
