"""What merging reads many times is made once."""

from veridica.plans import catalog
from veridica.plans.fixture import load


def test_relationships_of_a_merge_are_written_once(spark):
    rows = catalog.merge_state(load(spark, "/root/testdata/sf0.001"))["relationships"]
    files = rows.inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
