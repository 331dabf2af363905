import os

import pytest

from tideline.session import local_session
from tideline.streaming.native import use_rocksdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    use_rocksdb(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
