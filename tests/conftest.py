import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftlog.session import build_session, ensure_utc  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ensure_utc(build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}))
    yield session
    session.stop()
