"""Views and queries over them take every row of their tables."""

import pytest
from pyspark.sql import functions as F

from secflow.plans.normalize_queries import identity
from secflow.plans.views import view

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,table,times", [("v_links", "orders", 1), ("v_actions", "orders", 4), ("v_users", "customer", 1), ("v_advisories", "part", 1)])
def test_views_are_whole(spark, name, table, times):
    assert view(spark, SF, name).count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_user_is_an_identity(spark):
    users = spark.createDataFrame([(1, "user1@corp.example"), (151, "user1@other1.example"), (200, "user50@other1.example")], "user_id long, email string")
    events = spark.createDataFrame([(1, 200, 2), (2, 1, 1), (3, 1, 2), (4, 151, 2)], "event_id long, user_id long, k long").withColumn("principal", F.concat(F.lit("user"), "user_id", F.lit("@corp.example")))
    got = sorted((r.event_id, r.canonical, r.is_service) for r in identity(events, users).collect())
    assert got == [(1, "user50@other1.example", True), (2, "user1@corp.example", False), (3, "user1@corp.example", False), (4, "user1@other1.example", False)]
