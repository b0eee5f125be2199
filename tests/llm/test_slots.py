"""The slots of a mix are as many as its blocks, and stay on the executors."""

from pyspark.sql import functions as F

from mediacast.llm import mixing
from mediacast.session import stage


def test_slots_are_not_sent_by_way_of_the_driver(spark):
    rows = [(i, "w " * 400, f"s{i % 3}") for i in range(3000)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    targets = stage(mixing.source_targets(sizes), "targets")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        slots, _ = mixing.schedule(targets, 16)
        assert slots.count() > 50_000
        joined = spark.range(10**6).withColumn("rank", F.col("id")).join(slots, "rank", "left")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
