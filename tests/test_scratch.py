"""What operators write beside their results is deleted."""

import glob

import pytest

from tidelog.plans.queries import QUERIES
from tidelog.sources.log import scratch, shared_dir

from .test_changelog import SF


@pytest.mark.parametrize("query", ["rle_nodes", "reconcile_full", "store_append_idempotent", "store_range_fingerprints"])
def test_nothing_is_left_after_a_query(spark, query):
    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/tidelog/*"))
    with scratch(spark) as folder:
        assert QUERIES[query](spark, SF).count() > 0
        assert glob.glob(folder.removeprefix("file:") + "/*")
    assert set(glob.glob(shared_dir(spark).removeprefix("file://") + "/tidelog/*")) == before


def test_a_store_leaves_only_its_own_files(spark):
    with scratch(spark) as folder:
        QUERIES["store_append_idempotent"](spark, SF).collect()
        assert [f.rsplit("/", 1)[1].split("-")[0] for f in glob.glob(folder.removeprefix("file:") + "/*")] == ["store"]
