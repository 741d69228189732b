"""Helpers that keep global ordering, quantiles and small-side joins safe on large skewed data."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.session import ensure_checkpoint_dir

PASS_ROWS = 20_000


class RoundTables:
    """Parquet tables of a repeated step in the shared checkpoint folder.

    A table read back has the size of its files, whereas the estimated size of a checkpointed join grows from round to
    round. A table that no later round reads can be dropped.
    """

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def store(self, frame: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that :meth:`store` returned."""
        jvm = self.spark._jvm
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def collect_passes(frame: DataFrame, keys: Sequence[str], rows: int = PASS_ROWS):
    """Yields the rows of a configuration-like frame in passes of about ``rows``, so that any number is handled.

    ``keys`` identify rows; passes are cut by their hash.
    """
    total = frame.count()
    passes = max(1, -(-total // rows))
    for i in range(passes):
        part = frame if passes == 1 else frame.where(F.pmod(F.xxhash64(*keys), F.lit(passes)) == i)
        yield part.collect()


def _ranged(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows range partitioned by ``order`` and checkpointed, with the number of their range in ``_bucket``.

    The checkpoint pins the ranges: counts and positions read the same assignment even after a lost executor.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()).checkpoint()


def global_position(frame: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based position of each row in the total order of ``order``, which must identify rows.

    Rows are range partitioned and a position is the place in the range plus the row count of the earlier ranges,
    so no task sees more than one range.
    """
    ranged = _ranged(frame, order)
    counts = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range reaches this window
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        ranged.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (F.col("_place") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_place", "_offset")
    )


def exact_quantiles(frame: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles of one numeric column as a one-row frame ``q0, q1, ...``.

    Values are first reduced to distinct value counts (map-side combined). Ranges give every value its positions
    and only the two values that bracket each point are kept.
    """
    counts = (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counts = _ranged(counts, ["_v"])
    totals = counts.groupBy("_bucket").agg(F.sum("_c").alias("_t"))
    wide = Window.orderBy("_bucket")
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_t").over(wide.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_t").over(wide.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    run = Window.partitionBy("_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(offsets), "_bucket").withColumn("_hi", F.sum("_c").over(run) + F.col("_o") - 1)
    placed = placed.withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    aggs = []
    for i, p in enumerate(points):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((F.col("_lo") <= low) & (low <= F.col("_hi")), F.col("_v"))).alias(f"_l{i}"))
        aggs.append(F.max(F.when((F.col("_lo") <= high) & (high <= F.col("_hi")), F.col("_v"))).alias(f"_h{i}"))
        aggs.append(F.max(pos - low).alias(f"_f{i}"))
    row = placed.agg(*aggs)
    return row.select(
        *[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(points))
        ]
    )
