import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from corpusloom.session import let_workers_import, local_session  # noqa: E402

DATA = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    let_workers_import(s)
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)
