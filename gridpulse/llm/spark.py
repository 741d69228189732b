"""Spark-side helpers of the corpus operators: sizing, pinned intermediates, typed inputs."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpulse.llm.arrays import NULL_ID, lean
from gridpulse.session import ensure_checkpoint_dir


def pinned(frame: DataFrame) -> DataFrame:
    """The frame's rows in the shared checkpoint folder, so that every later read sees the same rows."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame's rows as a Parquet table in the shared folder.

    For steps that repeat: a checkpoint keeps the estimated size of its plan, which joins multiply from round to round.
    """
    path = shared_folder(frame.sparkSession, "table")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prime_at_least(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def text_bytes(frame: DataFrame, column: str = "text") -> int:
    return frame.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]


def buckets_for(total_bytes: int, each: int = 8 << 20) -> int:
    """A prime number of buckets of about ``each`` bytes; it grows with the input."""
    return prime_at_least(-(-total_bytes // each))


def id_bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.coalesce(column, F.lit(NULL_ID)), F.lit(buckets)).cast("int")


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` long and ``text`` string of any frame that has them, whatever else it has."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def sent(spark: SparkSession, model) -> Broadcast:
    """Broadcast of a model of fixed size, together with its code."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared: Broadcast):
    return pickle.loads(shared.value)


def add_task(kind: str, each: int):
    def task(batches):
        parts = []
        for batch in batches:
            parts += zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True)
        total = 0
        for _, raw in sorted(parts, key=lambda p: p[0]):
            total = total + np.frombuffer(raw, np.float32).astype(kind)
        for start in range(0, len(total) if parts else 0, each):
            yield pa.RecordBatch.from_pydict({"start": [start], "sums": [total[start : start + each].tobytes()]})

    return task


def summed(parts: DataFrame, kind: type = np.float32, each: int = 1 << 13) -> np.ndarray:
    """The sum of a few arrays of one fixed size, the raw float32 in ``sums`` of each row, one row a partition.

    One task adds them up in the order of the partitions, so that the driver gets one array, in rows of ``each`` numbers,
    and not an array a task.
    """
    name = np.dtype(kind).name
    dealt = parts.select(F.spark_partition_id().alias("part"), "sums").repartition(1)
    rows = dealt.mapInArrow(lean(add_task(name, each)), "start long, sums binary").collect()
    return np.frombuffer(b"".join(r["sums"] for r in sorted(rows, key=lambda r: r["start"])), name)


def numbered(frame: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``frame`` with ``place`` (from 0, in the ``order`` of its ``group``) and ``members`` (rows of the group).

    Rows are dealt in ranges over all groups and numbered in them, so a group of any size takes as many tasks as it fills;
    a window per group sees one row per range. Rows that tie in ``order`` are told apart by their place in ``frame``.
    """
    held = pinned(frame.withColumn("_row", F.monotonically_increasing_id()))
    whole = [group, *order, "_row"]
    # an id is the partition's number times 2**33 plus the row's number in it
    ranged = held.repartitionByRange(*whole).sortWithinPartitions(*whole).drop("_row")
    ranged = pinned(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(2**33 - 1))})
    spans = ranged.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        group,
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(group)).alias("members"),
    )
    return ranged.join(spans, [group, "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    rows: str | None = None,
    counted: DataFrame | None = None,
    how: str = "inner",
    crowd: int = 10_000,
) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key at most, so that no key gathers more rows than ``crowd``.

    Keys of over ``crowd`` rows of ``left`` get several salts: their right row is repeated for each. The list of such keys
    is sent to all tasks; it has at most one entry per ``crowd`` rows. ``rows`` names a column of ``right`` that holds a
    key's rows of ``left``, ``counted`` a frame with the same keys as ``left`` that is cheaper to count.
    """
    if rows:
        many = right.where(F.col(rows) > crowd).select(*keys, F.ceil(F.col(rows) / crowd).alias("_salts"))
    else:
        counted = left if counted is None else counted
        if counted.count() <= crowd:
            return left.join(right, keys, how)
        counts = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        many = counts.where(F.col("_n") > crowd).select(*keys, F.ceil(F.col("_n") / crowd).alias("_salts"))
    if not many.take(1):
        return left.join(right, keys, how)
    many = stored(many)
    others = [c for c in left.columns if c not in keys] or keys
    salt = F.coalesce(F.pmod(F.xxhash64(*others), F.col("_salts")), F.lit(0).cast("long"))
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1)
    left = left.join(F.broadcast(many), keys, "left").withColumn("_salt", salt).drop("_salts")
    right = right.join(F.broadcast(many), keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
