"""One Spark session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import get_spark

    os.environ.setdefault("FOLIOSCOPE_DRIVER_MEMORY", "4g")
    session = get_spark("tests", cores=4, partitions=4)
    yield session
    session.stop()
