import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from kiln.session import ship_package
    from kiln.session import build_session

    s = build_session("local[*]", "kiln-tests", {"spark.sql.shuffle.partitions": "8"})
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: a private folder when none is set
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kiln-test-ckpt-"))
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="kiln-test-")


def pytest_collection_finish(session):
    """Test modules are not importable in the Python workers: ship their
    functions and classes by value."""
    from pyspark import cloudpickle

    for mod in {item.module for item in session.items if getattr(item, "module", None)}:
        cloudpickle.register_pickle_by_value(mod)
