"""The store's index of processids that lie in several buckets."""

from specimen_spark.sources import store
from tests.test_plans import plan


def test_split_places_move_once(spark):
    rows = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 1), (None, 1), (None, 2), ("c", 3), ("c", 4)], "processid string, bucket int")
    got = store.split_places(rows, 3)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2), ("c", 3), ("c", 4)]
    text = plan(got)
    assert text.count("Exchange") == 1 and "collect_set" not in text
