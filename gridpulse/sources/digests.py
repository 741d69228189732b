"""SHA-256 of files of any size: Spark reads a file in splits, and tasks take turns on its one chain of blocks."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.session import ensure_checkpoint_dir

# task functions travel with their code, so workers need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = 112  # bytes of OpenSSL's SHA256_CTX: eight words, the length, a block and two counters


def openssl():
    """The SHA-256 functions that Python's hashlib is linked with, whose state is plain bytes; None if they can't be reached."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_char_p], [ctypes.c_char_p, ctypes.c_char_p]
        chain = Chain(lib)
        chain.update(b"a" * 70)
        chain = Chain(lib, chain.state())
        chain.update(b"b" * 70)
        return lib if chain.hexdigest() == hashlib.sha256(b"a" * 70 + b"b" * 70).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


class Chain:
    """A SHA-256 that can be left in one task and taken up in another."""

    def __init__(self, lib, state: bytes | None = None):
        self.lib, self.held = lib, ctypes.create_string_buffer(STATE)
        if state is None:
            lib.SHA256_Init(self.held)
        else:
            self.held.raw = state

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.held, data, len(data))

    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.held)
        return out.raw.hex()


def pieces_task(most: int):
    """Lines of a split end to end, in numbered pieces of about ``most`` bytes."""

    def task(batches):
        key, number, waiting, size = None, 0, [], 0

        def row():
            nonlocal number, size
            columns = zip(("file", "start", "number", "bytes"), (*key, number, b"".join(waiting)), strict=True)
            number, size = number + 1, 0
            waiting.clear()
            return pa.RecordBatch.from_pylist([dict(columns)], schema=schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            names, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            place = names.indices.to_numpy()
            new = (np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-1) != 0)
            cuts = np.append(np.flatnonzero(new), batch.num_rows).tolist()
            lines = batch.column("bytes")
            wide = pa.types.is_large_binary(lines.type)
            offsets = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset :]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = (names.dictionary[int(place[a])].as_py(), int(starts[a]))
                if own != key:
                    if waiting:
                        yield row()
                    key, number = own, 0
                waiting.append(lines.buffers()[2][int(offsets[a]) : int(offsets[b])].to_pybytes())
                size += len(waiting[-1])
                if size >= most:
                    yield row()
        if waiting:
            yield row()

    return task


def turn_task(todo: dict[str, tuple[int, int, bytes | None]], only: bool):
    """Takes the chains on by the pieces of this turn; ``todo`` has the length, the bytes done and the state of each file."""

    def task(batches):
        lib = openssl()
        if lib is None and not only:
            raise RuntimeError("executors can't reach the SHA-256 functions that the driver's Python is linked with")
        files: dict[str, list] = {}
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("bytes"), strict=True):
                length, done, state = todo[name]
                chain = files.setdefault(name, [hashlib.sha256() if lib is None else Chain(lib, state), done])
                data = data.as_py()[: length - chain[1]]  # the reader's last line end may not be in the file
                chain[0].update(data)
                chain[1] += len(data)
        rows = {"file": [], "done": [], "state": [], "sha256": []}
        for name, (chain, done) in files.items():
            ended = done == todo[name][0]
            values = (name, done, None if ended else chain.state(), chain.hexdigest() if ended else None)
            for column, value in zip(rows.values(), values, strict=True):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for (n, v), k in zip(rows.items(), kinds, strict=True)})

    return task


def large_digests(spark: SparkSession, path: str, pattern: str, turn: int) -> dict[str, str | None]:
    """SHA-256 of each file of more than ``turn`` bytes, by its path in ``_metadata``.

    Spark's text reader deals the splits of a file, whose lines, ended by the one byte ``\\n``, are kept as they are and
    stored in pieces. The chain of blocks goes through a file from turn to turn: a task reads the pieces of one turn, about
    ``turn`` bytes of each of its files, and hands the state on. Without OpenSSL's functions, one task reads all of a file.
    Files that the reader alters (it opens compressed ones by their name, and drops a byte order mark) have None.
    """
    options = {"lineSep": "\n", "pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    lines = spark.read.options(**options).text(path).where(size > turn)
    files = spark.read.format("binaryFile").options(**options).load(path).where(F.col("length") > turn)
    sizes = {r["file"]: r["length"] for r in files.select(name.alias("file"), "length").collect()}
    if not sizes:
        return {}
    lines = lines.select(name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.concat("value", F.lit("\n")).cast("binary").alias("bytes"))
    pieces = lines.mapInArrow(pieces_task(2 << 20), "file string, start long, number long, bytes binary")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    pieces = pieces.withColumns({"size": F.octet_length("bytes").cast("long"), "turn": F.floor(F.col("start") / turn)})
    # a reader holds many rows of a file at once, so files are short
    pieces.write.partitionBy("turn").option("compression", "none").option("maxRecordsPerFile", 8).parquet(folder)
    pieces = spark.read.schema("file string, start long, number long, bytes binary, size long, turn long").parquet(folder)
    read = pieces.groupBy("file").agg(F.sum("size").alias("n")).collect()
    todo = {r["file"]: (sizes[r["file"]], 0, None) for r in read if r["n"] - sizes[r["file"]] in (0, 1)}
    found = dict.fromkeys(sizes)
    resumed = openssl() is not None
    turns = -(-max(sizes.values()) // turn) if resumed else 1
    for number in range(turns):
        if not todo:
            break
        own = pieces.where(F.col("file").isin(list(todo)))
        own = own.where(F.col("turn") == number) if resumed else own
        own = own.select("file", "start", "number", "bytes").repartition(len(todo), "file").sortWithinPartitions("file", "start", "number")
        for r in own.mapInArrow(turn_task(todo, not resumed), "file string, done long, state binary, sha256 string").collect():
            length, _, _ = todo.pop(r["file"])
            if r["sha256"]:
                found[r["file"]] = r["sha256"]
            else:
                todo[r["file"]] = (length, r["done"], bytes(r["state"]))
    return found


def with_digests(files: DataFrame, spark: SparkSession, path: str, pattern: str, turn: int) -> DataFrame:
    """``files`` (Spark's binaryFile rows) with the column ``sha256``; files of up to ``turn`` bytes are read whole."""
    whole, name = F.sha2("content", 256).alias("sha256"), F.col("_metadata.file_path")
    columns = [c for c in files.columns if c != "content"]
    found = large_digests(spark, path, pattern, turn)
    out = files.where(F.col("length") <= turn).select(*columns, whole)
    known = [(k, v) for k, v in found.items() if v]
    if known:
        large = files.where(F.col("length") > turn).select(*columns, name.alias("_file"))
        known = spark.createDataFrame(known, "_file string, sha256 string")
        out = out.unionByName(large.join(F.broadcast(known), "_file").select(*columns, "sha256"))
    left = [k for k, v in found.items() if not v]
    return out.unionByName(files.where(name.isin(left)).select(*columns, whole)) if left else out
