"""WARC archives: writing captures and assembling them again from their records.

Each page becomes a response (or revisit), a request and a metadata record. Archives are plain files that Spark writes
to and reads from a shared folder. Reading parses every record by its own lengths, and request, response and metadata
records find each other again through their concurrent-to identifiers in joins, one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridpulse.llm.arrays import NULL_ID, lean
from gridpulse.llm.spark import shared_folder, text_bytes

LINE = "\r\n"
RECORD_END = LINE * 2
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "declared_digest string, payload_digest string, payload_bytes long, page_id long, payload binary"
)


def _record_id(kind: str, key: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), key.cast("string"), digest, copy.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record; headers whose value is null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{LINE}{k}: "), v)).otherwise("") for k, v in headers]
    size = F.concat(F.lit(f"{LINE}Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1"), *lines, size, F.lit(RECORD_END), block)


def capture_roles(pages: DataFrame, least: int, parts: int) -> DataFrame:
    """``pages`` with payload, digest, size, copy number and the page that each revisit refers to, in ``parts`` parts."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("key", F.coalesce("page_id", F.lit(NULL_ID)))
    digests = own.select("key", "page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    # nulls come last among ids, so a null page is a revisit of any other
    heads = (
        digests.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND head IS NOT NULL")
        .drop("n")
    )
    again = (
        digests.join(heads, "digest")
        .where(F.col("page_id").isNull() | (F.col("page_id") > F.col("head")))
        .select("key", "digest", "head")
        .distinct()
    )
    # dealt once: the join, the copy numbers and the archives all use this partitioning
    dealt = own.withColumn("digest", F.sha2("payload", 256)).repartition(parts, "key", "digest")
    marked = dealt.join(again, ["key", "digest"], "left")
    return marked.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")))


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = 16 << 20) -> None:
    """Writes a response or revisit, a request and a metadata record for each page to archives below ``folder``.

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id has the response and the
    others revisit it. Archives hold about ``archive_bytes`` each, dealt by page and payload, and are gzipped as a whole.
    """
    total = text_bytes(pages, "html")
    c = capture_roles(pages, least, max(1, -(-total // archive_bytes)))
    date = F.lit("2024-01-01T00:00:00Z")
    main = _record_id("capture", F.col("key"), F.col("digest"), F.col("copy"))
    head = _record_id("capture", F.col("head"), F.col("digest"), F.lit(1))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(RECORD_END),
    )
    revisit = F.col("head").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, head)),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    path = F.coalesce(F.nullif(F.regexp_replace("url", r"^\w+://[^/]*", ""), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/]*)", 1), F.lit(""))
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _record_id("request", F.col("key"), F.col("digest"), F.col("copy"))),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{LINE}Host: "), host, F.lit(RECORD_END)),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _record_id("metadata", F.col("key"), F.col("digest"), F.col("copy"))),
            ("WARC-Date", date),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE)),
    )
    (
        c.select(F.concat_ws(RECORD_END, response, request, metadata).alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .text(folder)
    )


def parse_records(data: bytes, keep_payload: bool):
    """Records of one archive, walked by their lengths; a digest that its payload does not have is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode().split(LINE)[1:]:
            name, _, value = line.partition(": ")
            fields[name.lower()] = value
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        kind = fields["warc-type"]
        row = {
            "record_id": fields["warc-record-id"],
            "record_type": kind,
            "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"),
        }
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            http = dict(x.split(": ", 1) for x in head.decode().split(LINE)[1:])
            row["declared_digest"] = fields["warc-payload-digest"].partition(":")[2]
            row["payload_bytes"] = int(http["Content-Length"])
            if kind == "response":
                row["payload_digest"] = hashlib.sha256(body).hexdigest()
                if row["payload_digest"] != row["declared_digest"] or len(body) != row["payload_bytes"]:
                    raise ValueError(f"payload of {row['record_id']} does not match its header")
                row["payload"] = body if keep_payload else None
        elif kind == "metadata":
            number = block.decode().partition("page-id: ")[2].strip()
            row["page_id"] = int(number) if number else None
        yield row


def record_task(keep_payload: bool):
    schema = pa.schema(
        [(n.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]]) for n in RECORD_SCHEMA.split(", ")]
    )

    def task(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parse_records(zlib.decompress(content.as_py(), 31), keep_payload)) if content.as_py() else []
                for a in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 4096], schema)

    return task


def read_records(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """One row per WARC record of all archives in the folder."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(lean(record_task(keep_payload)), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, page_id, response, request, metadata, refers_to_page``.

    Requests and metadata join the response or revisit they are concurrent to; a capture without one of them keeps a
    null there, and records whose capture is missing make no row. A revisit's page comes from the response it names.
    """
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.struct("record_type", "target_uri", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "payload").alias("response"),
    )
    request = records.where(F.col("record_type") == "request").select(
        F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri").alias("request")
    )
    metadata = records.where(F.col("record_type") == "metadata").select(
        F.col("concurrent_to").alias("capture_id"), "page_id", F.struct("record_id", "page_id").alias("metadata")
    )
    joined = main.join(metadata, "capture_id", "left").join(request, "capture_id", "left")
    responses = joined.where(F.col("response.record_type") == "response").withColumn("refers_to_page", F.lit(None).cast("long"))
    heads = responses.select(F.col("capture_id").alias("_head"), F.col("page_id").alias("refers_to_page"))
    revisits = joined.where(F.col("response.record_type") == "revisit").join(
        heads, F.col("response.refers_to") == F.col("_head"), "left"
    )
    return responses.unionByName(revisits.drop("_head"))


def captures(pages: DataFrame, least: int = 100, archive_bytes: int = 16 << 20, keep_payload: bool = False) -> DataFrame:
    """Archives of all ``pages`` (``page_id``, ``url``, ``html``) written below the shared folder, read back and assembled.

    Null html is empty, a null url is left out of the records, a null page id stays null and comes after all others.
    Repeated rows make a capture each; rows that share id and payload with the smallest id are all responses. Other
    columns are ignored; an empty table gives no archives and an empty result.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "archives")
    write_archives(pages, folder, least, archive_bytes)
    return assemble(read_records(spark, folder, keep_payload))


def query_rows(assembled: DataFrame) -> DataFrame:
    return assembled.select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.declared_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )
