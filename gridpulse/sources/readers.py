"""Readers for parquet, csv and json, with provenance, digests and inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.cleaning import trim_column_names
from gridpulse.sources.digests import with_digests

MODES = ("parquet", "csv", "json")


def read_source(spark: SparkSession, path: str | Sequence[str], mode: str, **options: str) -> DataFrame:
    """Read by mode; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown read mode {mode!r}; known: {', '.join(MODES)}")
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(**options)
    if mode == "csv":
        return reader.csv(paths, header=True)
    return reader.parquet(*paths) if mode == "parquet" else reader.json(paths)


def read_text_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Every column as text: no inference, blanks stay blank, a byte order mark is cut from the header."""
    frame = spark.read.csv(
        path if isinstance(path, str) else list(path),
        header=True, sep=sep, inferSchema=False, emptyValue="", encoding="UTF-8",
    )
    return trim_column_names(frame).fillna("")


@dataclass(frozen=True)
class MergeResult:
    frame: DataFrame
    skipped: list[str]
    rows_before: DataFrame
    rows_after: DataFrame


def merge_files(
    spark: SparkSession, paths: Sequence[str], sep: str = ";", drop: Sequence[str] = ()
) -> MergeResult:
    """Union of the files whose header equals the first file's, without repeated rows and dropped columns.

    Accepted files are read by one scan. Counts are lazy one-row frames.
    """
    ordered = sorted(paths)
    if not ordered:
        raise FileNotFoundError("no file matches the prefix")
    headers = {p: spark.read.csv(p, header=True, sep=sep, inferSchema=False).columns for p in ordered}
    kept = [p for p in ordered if headers[p] == headers[ordered[0]]]
    merged = read_text_csv(spark, kept, sep)
    distinct = merged.dropDuplicates()
    out = distinct.drop(*[c for c in drop if c in merged.columns])
    count = F.count(F.lit(1)).alias("rows")
    return MergeResult(out, [p for p in ordered if p not in kept], merged.agg(count), distinct.agg(count))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, text: str = "text") -> DataFrame:
    """Rows of a json-lines corpus; broken lines and blank texts are left out."""
    frame = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return frame.where(F.length(F.trim(F.col(text))) > 0)


def read_nested_weather(spark: SparkSession, path: str, header: Mapping[str, str], items: str = "data") -> DataFrame:
    """One row per element of ``items`` with the header fields copied onto it."""
    frame = spark.read.json(path, multiLine=True)
    return explode_items(frame, header, items)


def explode_items(frame: DataFrame, header: Mapping[str, str], items: str = "data") -> DataFrame:
    return frame.select(
        *[F.col(source).alias(name) for name, source in header.items()], F.explode(items).alias("_item")
    ).select(*header, "_item.*")


def with_provenance(frame: DataFrame, logical_name: str, root: str = "") -> DataFrame:
    """Logical name, path below ``root``, file name and ingest time."""
    path = F.col("_metadata.file_path")
    return frame.select(
        "*",
        F.lit(logical_name).alias("source_logical_name"),
        F.regexp_replace(path, f"^(file:)?/*{root.strip('/')}/?", "").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.current_timestamp().alias("ingested_at"),
    )


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", digest: bool = False, turn: int = 128 << 20) -> DataFrame:
    """Path, name, bytes and modification time of every file; SHA-256 of the content on demand.

    Files of over ``turn`` bytes are digested at once, by tasks that read about so much of a file each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = [
        F.col("path"),
        F.regexp_extract("path", "[^/]+$", 0).alias("file_name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    ]
    if digest:
        files = with_digests(files, spark, path, pattern, turn)
        out.append(F.col("sha256"))
    return files.select(*out)


def availability(manifest: DataFrame, inventory: DataFrame, name: str = "file_name") -> DataFrame:
    """Manifest rows with AVAILABLE or MISSING, and DIGEST_MISMATCH where both sides state a digest."""
    side = inventory.select(F.col(name).alias("_n"), "bytes", *([F.col("sha256").alias("_d")] if "sha256" in inventory.columns else []))
    joined = manifest.join(side, F.col(name) == F.col("_n"), "left")
    status = F.when(F.col("_n").isNull(), "MISSING")
    if "sha256" in manifest.columns and "sha256" in inventory.columns:
        status = status.when(F.col("sha256") != F.col("_d"), "DIGEST_MISMATCH")
    return joined.withColumn("status", status.otherwise("AVAILABLE")).drop("_n", "_d")


def require_available(log: DataFrame, name: str = "file_name") -> DataFrame:
    bad = log.where("status <> 'AVAILABLE'").limit(20).collect()
    if bad:
        raise FileNotFoundError(", ".join(f"{r[name]} {r['status']}" for r in bad))
    return log


MANIFEST_SCHEMA = (
    "logical_name string, path string, mode string, bronze_table string, primary_key array<string>, "
    "foreign_keys array<string>, required_columns array<string>, expected_rows long"
)


def manifest_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per raw source of a JSON manifest; lists are kept as JSON text."""
    frame = spark.read.schema(f"raw_sources array<struct<{MANIFEST_SCHEMA.replace(' string', ':string').replace(' array', ':array').replace(' long', ':long')}>>").json(path, multiLine=True)
    rows = frame.select(F.explode("raw_sources").alias("s")).select("s.*")
    return rows.select(
        *[F.to_json(f.name).alias(f"{f.name}_json") if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields]
    )


def ingest_log(sources: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, columns, earliest and latest moment over all date columns together, per source."""
    out = None
    for name, (frame, dates) in sources.items():
        stamps = [F.col(d).cast("timestamp") for d in dates if d in frame.columns]
        low = [F.min(s) for s in stamps]
        high = [F.max(s) for s in stamps]
        none = F.lit(None).cast("timestamp")
        row = frame.agg(
            F.count(F.lit(1)).alias("row_count"),
            (F.least(*low) if len(low) > 1 else low[0] if low else F.max(none)).alias("min_date"),
            (F.greatest(*high) if len(high) > 1 else high[0] if high else F.max(none)).alias("max_date"),
        ).select(F.lit(name).alias("logical_name"), "row_count", F.lit(len(frame.columns)).alias("column_count"), "min_date", "max_date")
        out = row if out is None else out.unionByName(row)
    return out


def project_columns(frame: DataFrame, required: Sequence[str], variables: Sequence[str] = (), offsets: Sequence[int] = ()) -> DataFrame:
    """Required and generated ``<variable>_<offset>`` columns that exist, each once; all columns if none is named."""
    wanted = [*required, *[f"{v}_{o}" for v in variables for o in offsets]]
    kept = [c for c in dict.fromkeys(wanted) if c in frame.columns]
    return frame.select(*kept) if kept else frame


def with_columns_present(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds each absent column as a typed null."""
    return frame.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in frame.columns})
