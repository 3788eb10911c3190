import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from qtrlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app_name="qtrlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="qtrlens-test-")


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from qtrlens.sources.fixtures import DRIVER_TABLES
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con
