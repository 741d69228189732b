"""What the driver gets and starts for the models of op6_quality and op10_benchmark_leaks, whatever the settings."""

import numpy as np
from pyspark.sql import functions as F

from gridpulse.llm import leaks
from gridpulse.llm.spark import summed


def test_leak_search_takes_as_many_jobs_with_more_partitions(spark):
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 20])) for i in range(20)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(words[i : i + 8])) for i in range(5)], "item_id long, text string")
    asked = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    context = spark.sparkContext
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        context.setJobGroup("leaks", "leaks")
        found = leaks.leaks(docs, benchmark).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("leaks"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(i, i) for i in range(5)} <= {(r["doc_id"], r["item_id"]) for r in found}
    assert 0 < jobs < 60


def test_arrays_of_tasks_are_added_up_before_the_driver_gets_them(spark):
    rows = np.random.default_rng(1).normal(size=(5, 1000)).astype(np.float32)
    parts = spark.createDataFrame([(i, rows[i].tobytes()) for i in range(5)], "i long, sums binary").repartition(5, "i")
    for kind in (np.float32, np.float64):
        got = summed(parts, kind, each=300)
        assert got.dtype == kind and len(got) == 1000
        assert np.allclose(got, rows.astype(np.float64).sum(axis=0), atol=1e-5)
    assert len(summed(parts.where(F.col("i") < 0))) == 0
