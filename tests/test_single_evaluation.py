"""Records are mapped once, whatever reads the result: no plan repeats the mapping for a filter or a leaf."""

from pyspark.sql import functions as F

from secflow.functions.versions import limits
from secflow.operators import supply_chain as S
from secflow.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_filters_don_t_map_again(spark):
    assert plan(spark, "snk_dlq").count("get_json_object") <= 150


def test_leaves_share_what_they_need(spark):
    """The syslog header and the time are each found by one projection; with all leaves in one, each leaf and each test for null repeats them."""
    for name in ("norm_stamp", "norm_document"):
        text = plan(spark, name)
        assert text.count("try_variant_get") <= 45 and text.count("try_parse_json") <= 1, text.count("try_variant_get")


def test_a_cloud_call_reads_each_path_once(spark):
    assert plan(spark, "norm_cloudtrail").count("get_json_object") <= 20


def test_a_range_is_parsed_once_for_all_advisories_that_name_it(spark):
    texts = [("a", ">=1.0.0 <2.0.0", "2.0.0"), ("b", ">=1.0.0 <2.0.0", "2.0.0"), ("c", None, None), ("d", None, "2.0.0"), ("e", "", None), ("f", "^1.2", "")]
    advisories = spark.createDataFrame(texts * 2, "vuln_id string, affected string, fixed string").coalesce(1)
    made = S.with_bounds(advisories, limits(F.col("affected")), "affected", "fixed")
    assert sorted(r.vuln_id for r in made.collect()) == sorted(t[0] for t in texts * 2)
    want = advisories.withColumn("bounds", limits(F.col("affected")))
    key = lambda r: repr(r)
    assert sorted(made.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_affected" in plan and "Repartition" in plan
