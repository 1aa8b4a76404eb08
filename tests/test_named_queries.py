"""Every named query against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

from sparkbi.plans.registry import load

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()))
def test_matches_sql(spark, db, name):
    assert compare(spark, db, FOLDER, name, load()[name]) is None
