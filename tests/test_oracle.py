"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as registered
from samplewright.plans.registry import QUERIES
from tests.oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


PYTHON_QUERIES = {
    "user_collate", "user_transform", "epoch_images", "decode_resize", "decode_normalise", "eval_crop", "augment_pixels",
    "eval_crop_shrunk", "augment_pixels_shrunk", "decode_files",
    "shard_roundtrip", "zip_roundtrip", "tar_roundtrip",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df, sql = registered.queries()[name](spark, SF_DIR), registered.oracle_sql().get(name)
    plan = df._jdf.queryExecution().toString()
    if name not in PYTHON_QUERIES:
        assert not re.search("MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|PythonUDTF", plan)
    assert "CartesianProduct" not in plan
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(con, df, sql) is None


def test_entry(spark):
    assert registered.entry(spark).columns == ["batch_id", "size", "labels"]
    assert set(registered.oracle_sql()) <= set(registered.queries())
