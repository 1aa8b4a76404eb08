from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkbi.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(params=[1, 4, 64])
def partitions(request, spark):
    """Results must not depend on how the data is spread; small blocks stay apart here."""
    wanted = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)
