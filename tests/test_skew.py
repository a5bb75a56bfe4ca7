"""A key with a third of all rows is spread although adaptive execution is off."""

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions.skew import join_spread
from specimen_spark.operators import grade, groups


@pytest.fixture()
def plain_execution(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_key(spark, plain_execution):
    rows = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 5000) end k", "id")
    keyed = spark.range(5000).selectExpr("concat('k', id) k", "id * 2 v").union(spark.sql("select 'hot' k, -1L v union all select 'hot', -2L union all select null, 0L"))
    usual, spread = rows.join(keyed, "k"), join_spread(rows, keyed, "k")
    assert spread.columns == usual.columns
    assert spread.groupBy("k").agg(F.count("*"), F.sum("v"), F.sum("id")).exceptAll(usual.groupBy("k").agg(F.count("*"), F.sum("v"), F.sum("id"))).count() == 0
    assert spread.count() == usual.count()
    assert largest_share(usual) > 0.3 and largest_share(spread) < 0.15
    assert join_spread(rows.limit(0), keyed, "k").count() == 0


def test_members_of_a_hot_bin(spark, plain_execution):
    """A BIN that holds a third of all rows, most of other ranks than species."""
    rows = spark.range(30_000).selectExpr(
        "concat('P', id) processid", "case when id % 3 = 0 then 'BIN:hot' else concat('BIN:', id % 900) end bin_uri",
        "case when id % 3 = 0 and id > 30 then null else concat('Aus s', translate(string(id % 900), '0123456789', 'abcdefghij')) end species",
        "case when id % 3 = 0 and id > 30 then 'genus' else 'species' end identification_rank", "1.0D quality_score")
    grades = grade.bags_grades(rows)
    for frame in (groups.grade_members(rows, grades), groups.group_by_species_bin(rows)):
        assert largest_share(frame) < 0.2
    members = groups.grade_members(rows, grades)
    assert members.filter("identification_rank = 'genus'").select("processid").distinct().count() == rows.filter("identification_rank = 'genus'").count()
