"""Table writes, upserts, seeds, readiness and the cleanup job. Parquet tables, one folder per table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.scale import RoundTables


def write_table(frame: DataFrame, path: str, partition_by: Sequence[str] = (), records_per_file: int | None = None, fmt: str = "parquet") -> None:
    """Overwrite data and schema; file size is bounded by the writer, not by driver-side chunks."""
    writer = frame.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_table(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def json_events(frame: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for append-only event tables."""
    return frame.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f"`{f.name}`")
            for f in frame.schema.fields
        ]
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], updated: str = "updated_at") -> DataFrame:
    """Current rows replaced or joined by the change rows of the same key; the latest change wins.

    Changed keys leave the current side by an anti-join, so untouched rows are not ranked.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(updated), F.desc(F.xxhash64(*changes.columns)))
    latest = changes.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    kept = current.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _in_partitions(frame: DataFrame, columns: Sequence[str], values: Sequence) -> Column:
    """Rows of the given partitions, as a test that prunes folders."""
    kinds = {c: frame.schema[c].dataType for c in columns}
    test = F.lit(False)
    for row in values:
        own = F.lit(True)
        for c in columns:
            own &= F.col(c).isNull() if row[c] is None else F.col(c) == F.lit(row[c]).cast(kinds[c])
        test |= own
    return test


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], partition_by: Sequence[str], updated: str = "updated_at") -> DataFrame:
    """Upsert into a Parquet table partitioned by ``partition_by``, rewriting only the partitions that the changes meet.

    The partitions that hold a changed key, and those that the changes go to, are found first; only they are read, merged and
    written over, so all other files stay as they are. The latest change of a key wins, and a null key equals a null key. A
    row whose partition changes leaves its old one; a partition left empty is removed. Returns the partitions met. The list
    of them is kept by the driver, a row per partition folder.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(updated), F.desc(F.xxhash64(*changes.columns)))
    tables = RoundTables(spark)
    latest = tables.store(changes.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn"))
    current = spark.read.parquet(path)
    marked = latest.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same &= _same(k, f"_key_{k}")
    there = current.select(*keys, *[c for c in partition_by if c not in keys]).join(marked, same, "left_semi").select(*partition_by)
    kinds = [F.col(c).cast(current.schema[c].dataType).alias(c) for c in partition_by]
    met = there.unionByName(latest.select(*kinds)).distinct().collect()
    if not met:
        return spark.createDataFrame([], current.select(*partition_by).schema)
    own = current.where(_in_partitions(current, partition_by, met))
    files = own.select(*partition_by, F.input_file_name().alias("_file")).distinct().collect()
    merged = own.join(marked, same, "left_anti").unionByName(latest.withColumns(dict(zip(partition_by, kinds, strict=True))), allowMissingColumns=True)
    merged = tables.store(merged)
    filled = {tuple(r) for r in merged.select(*partition_by).distinct().collect()}
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    for folder in {r["_file"].rsplit("/", 1)[0] for r in files if tuple(r[c] for c in partition_by) not in filled}:
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = spark.createDataFrame(met, current.select(*partition_by).schema)
    tables.drop(latest, merged)
    return out


def insert_missing(current: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seed rows whose key is absent; the caller appends them."""
    return seeds.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")


def write_set(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> DataFrame:
    """Write every table and return the manifest: table, format, rows and columns read back from storage."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, frame in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        write_table(frame, path, fmt=fmt)
        stored = spark.read.option("header", "true").format(fmt).load(path)
        row = stored.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(fmt).alias("format"), "rows", F.lit(json.dumps(stored.columns)).alias("columns_json")
        )
        out = row if out is None else out.unionByName(row)
    return out


def readiness(spark: SparkSession, required: Sequence[str]) -> DataFrame:
    """READY or MISSING per required catalogue table: it exists and has at least one column."""
    rows = []
    for name in required:
        ready = spark.catalog.tableExists(name) and len(spark.table(name).columns) > 0
        rows.append((name, "READY" if ready else "MISSING"))
    return spark.createDataFrame(rows, "table string, status string")


def cleanup(spark: SparkSession, candidates: Sequence[str], allowed: Sequence[str], dry_run: bool = True) -> DataFrame:
    """MISSING, PRESERVED_BLOCKED, DRY_RUN or DROPPED per table; only allow-listed tables are ever dropped."""
    rows = []
    for name in candidates:
        if not spark.catalog.tableExists(name):
            status = "MISSING"
        elif name not in set(allowed):
            status = "PRESERVED_BLOCKED"
        elif dry_run:
            status = "DRY_RUN"
        else:
            spark.sql(f"DROP TABLE {'.'.join(f'`{p}`' for p in name.split('.'))}")
            status = "DROPPED"
        rows.append((name, status))
    return spark.createDataFrame(rows, "table string, status string")
