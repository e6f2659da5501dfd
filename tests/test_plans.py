"""What the plans look like: pruning, pushdown, and how hot keys are split."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from caseledger.operators import filters as fl
from caseledger.operators import intake as it
from caseledger.operators import joins as jn
from caseledger.operators import links as lk
from caseledger.plans import intaking, records
from caseledger.plans.registry import Tables


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key.replace("__", "."), value)
        yield
    finally:
        for key, value in old.items():
            name = key.replace("__", ".")
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def small_thresholds(spark):
    """A few hundred kilobytes count as skewed, and nothing is small enough to broadcast."""
    prefix = "spark__sql__adaptive__"
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        **{
            f"{prefix}autoBroadcastJoinThreshold": "-1",
            f"{prefix}advisoryPartitionSizeInBytes": "64KB",
            f"{prefix}skewJoin__skewedPartitionThresholdInBytes": "64KB",
            f"{prefix}skewJoin__skewedPartitionFactor": "2",
            f"{prefix}coalescePartitions__enabled": "false",
            "spark__sql__shuffle__partitions": "16",
        },
    ):
        yield


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def hot(spark, n, key="k"):
    """A third of all rows share one key; the rest are nearly unique. Rows are wide."""
    source = spark.range(0, n, 1, 16)
    value = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    return source.select(value.alias(key), "id", F.sha2(F.col("id").cast("string"), 512).alias("pad"))


def test_outer_join_splits_a_hot_key_on_either_side(spark, small_thresholds):
    big = hot(spark, 60_000)
    one = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), F.lit("x").alias("y"))
    for left, right in ((big, one), (one, big)):
        joined = jn.outer_join(left, right, "k", "_r")
        assert "skew=true" in final_plan(joined)
        assert joined.count() == 60_000 + one.filter("k <> 0").join(big, "k", "left_anti").count()


def test_links_of_a_hot_incident_are_split(spark, small_thresholds):
    edges = hot(spark, 60_000, "incident_id").select(
        "incident_id", F.col("pad").alias("source_id"), F.col("id").alias("position"),
        F.lit(False).alias("is_primary"),
    )
    incidents = spark.range(60_000).select("id", F.lit("s").alias("status"))
    sources = edges.select(F.col("source_id").alias("id"), F.lit("p").alias("publisher"))
    assert "skew=true" in final_plan(lk.resolve_links(incidents, edges, sources))
    assert "skew=true" in final_plan(lk.with_primary(edges))


def test_copies_of_a_text_never_meet_with_their_text(spark, small_thresholds):
    # nine of ten are copies: equal hashes compress well, and sizes are compared compressed
    copy = F.when(F.col("id") % 10 > 0, F.lit("same")).otherwise(F.col("id").cast("string"))
    articles = spark.range(0, 100_000, 1, 16).select(
        F.col("id").alias("seq"), F.concat(F.lit("x" * 50), copy).alias("article_text")
    )
    stored = spark.createDataFrame([], "article_hash string")
    answers = spark.createDataFrame(
        [], "article_hash string, article_type string, confidence double, payload string"
    )
    assessed = it.assess(it.sources_from(articles, "pdf"), stored, answers)
    assert "skew=true" in final_plan(assessed)
    assert assessed.count() == 100_000


def test_listing_reads_and_pushes_only_what_it_needs(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    request = fl.IncidentFilters(verified="true", IUU_type="Other")
    page, _ = fl.list_incidents(records.incidents(t), records.sources(t), request)
    plan = page.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,250000.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    assert "TakeOrderedAndProject" in plan and "l_extendedprice" not in plan


def test_stored_incidents_are_read_by_leaf(spark, tmp_path):
    from caseledger.schemas import empty_tables
    from caseledger.sources.tables import read_collection, write_collection

    write_collection(empty_tables(spark)["incidents"], str(tmp_path), "incidents")
    stored = read_collection(spark, str(tmp_path), "incidents")
    found = stored.filter(fl.IncidentFilters(status="modified").predicate())
    plan = found.select("id", fl.EVENT_DATE)._jdf.queryExecution().executedPlan().toString()
    assert "vesselName" not in plan and "eventDate:string" in plan
    assert "EqualTo(status,modified)" in plan


def test_intake_joins_hashes_not_texts(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = intaking.predictions(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2")  # the hash is made below the join
    assert "Join" not in intaking._articles(t)._jdf.queryExecution().optimizedPlan().toString()
