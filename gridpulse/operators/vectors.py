"""Vector retrieval: exact cosine search, and an inverted-file index with probe lists and exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from gridpulse.scale import RoundTables

# Fixed bounds: values of the fitting sample, lists of an index, values of the queries of one search cell, queries and items
# scored together.
SAMPLE_VALUES, MOST_LISTS, CELL_VALUES, QUERY_ROWS, ITEM_ROWS = 4_000_000, 4_096, 2_000_000, 512, 1_024
# Values of the items that stream through a cell; pairs of a cell: enough for a task of its own, and the most.
STREAM_VALUES, FEW_PAIRS, MOST_PAIRS = 2**26, 2**26, 2**35
# Scores are compared in whole billionths; NONE stands for no item yet.
BILLION, NONE = 10**9, -(2**39)


def dimension_of(frame: DataFrame, vector: str) -> int:
    """Most common vector length (ties: the larger one); 0 without vectors."""
    row = frame.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def is_usable(vector: str, dimension: int) -> Column:
    """True for vectors of ``dimension`` finite numbers; null and ragged ones are neither indexed, searched nor found."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(values) == dimension) & finite, F.lit(False))


def _numbers(frame: DataFrame, vector: str, out: str) -> Column:
    """The vectors as arrays of floats if they are such, or else of doubles."""
    kind = frame.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(vector).cast("array<float>" if single else "array<double>").alias(out)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero and has cosine 0 with everything."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def _best(scores: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Columns of the ``k`` best scores of each row, ties by column."""
    for i, row in enumerate(scores):
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        yield i, at[np.argsort(-row[at], kind="stable")][:k]


def _ranked(found: DataFrame, query_id: str, item_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _result_schema(items: DataFrame, queries: DataFrame, item_id: str, query_id: str) -> str:
    kinds = (queries.schema[query_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    return f"`{query_id}` {kinds[0]}, `{item_id}` {kinds[1]}, score double"


class _Nearest:
    """The ``k`` best items of each query of a block, while items come by in any order.

    Products are taken in single precision, which rules out nearly every pair: one is kept where its score may reach the
    query's k-th best one, allowing for the most that single precision can be off. Those are scored in double precision, and
    ties go to the smaller row number, which follows the ids. Found pairs are put in order once there is one for four places.
    """

    def __init__(self, keys: pa.Array, vectors: np.ndarray, probes: np.ndarray | None, k: int):
        self.keys, self.unit, self.probes, self.k = keys, _unit(vectors), probes, k
        self.single = self.unit.astype(np.float32)
        count, dimension = vectors.shape
        self.slack = 1.1 * (dimension + 16) * 2.0**-24
        self.bar = np.full(count, -np.inf, np.float32)
        self.score, self.row = np.full((count, k), NONE), np.full((count, k), np.iinfo(np.int64).max)
        self.at = np.zeros((count, k), np.int64)
        self.ids: list[pa.Array] = []
        self.named, self.found, self.held = 0, [], 0

    def see(self, ids: pa.Array, vectors: np.ndarray, rows: np.ndarray, lists: np.ndarray) -> None:
        """A batch of items with the numbers of their rows and lists; a list's items stand together."""
        first, unit = self.named, _unit(vectors)
        self.ids.append(ids)
        self.named += len(ids)
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            mine = None
            if self.probes is not None:
                at = int(lists[start])
                mine = np.flatnonzero(self.probes[at >> 3] & (128 >> (at & 7)))
            for a in range(start, stop, ITEM_ROWS):
                b = min(a + ITEM_ROWS, stop)
                self._block(unit[a:b], rows[a:b], first + a, mine)
        if self.named > max(4 * self.at.size, 2**20):
            self._forget()

    def _block(self, unit: np.ndarray, rows: np.ndarray, first: int, mine: np.ndarray | None) -> None:
        single = unit.astype(np.float32).T
        count, step = len(self.unit) if mine is None else len(mine), max(QUERY_ROWS, QUERY_ROWS * ITEM_ROWS // len(unit))
        for a in range(0, count, step):
            who = slice(a, a + step) if mine is None else mine[a : a + step]
            block = self.single[who] @ single
            hot = np.flatnonzero(block.max(axis=1) >= self.bar[who])
            if len(hot):
                self._weigh(block[hot], hot + a if mine is None else who[hot], unit, rows, first)

    def _weigh(self, block: np.ndarray, who: np.ndarray, unit: np.ndarray, rows: np.ndarray, first: int) -> None:
        """Exact scores of the pairs of ``block`` that may be among the best; these are kept."""
        k, n = self.k, len(unit)
        bar = self.bar[who]
        hits = block >= bar[:, None]
        i, j = divmod(np.flatnonzero(hits), n)
        if n > k and len(many := np.flatnonzero(np.bincount(i) > 2 * k)):
            kth = np.partition(block[many], n - k, axis=1)[:, n - k]
            hits[many] = block[many] >= np.maximum(bar[many], kth - np.float32(2 * self.slack))[:, None]
            i, j = divmod(np.flatnonzero(hits), n)
        if len(i) * 32 > hits.size:
            score = np.rint((self.unit[who] @ unit.T) * BILLION)[i, j]
        else:
            some = max(1, CELL_VALUES // max(1, unit.shape[1]))
            parts = [np.einsum("ij,ij->i", self.unit[who[i[a : a + some]]], unit[j[a : a + some]]) for a in range(0, len(i), some)]
            score = np.rint(np.concatenate(parts) * BILLION)
        score, who, row = score.astype(np.int64), who[i], rows[j]
        last = self.score[who, -1]
        keep = np.flatnonzero((score > last) | ((score == last) & (row < self.row[who, -1])))
        self.found.append((who[keep], score[keep], row[keep], first + j[keep]))
        self.held += len(keep)
        if 4 * self.held >= self.score.size:
            self._settle()

    def _settle(self) -> None:
        """Found pairs take their places among the best ones."""
        if not self.found:
            return
        who, score, row, at = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        held = np.unique(who)
        best = (self.score, self.row, self.at)
        score, row, at = (np.concatenate([x[held].ravel(), y]) for x, y in zip(best, (score, row, at), strict=True))
        who = np.concatenate([np.repeat(np.arange(len(held)), self.k), np.searchsorted(held, who)])
        key = (who << 40) - score
        order = np.argsort(key)
        if (np.diff(key[order]) == 0).any():
            order = np.lexsort((row, key))
        # every query has k places at least, those of before
        pick = order[np.searchsorted(who[order], np.arange(len(held)))[:, None] + np.arange(self.k)]
        self.score[held], self.row[held], self.at[held] = score[pick], row[pick], at[pick]
        last = self.score[held, -1]
        self.bar[held] = np.where(last == NONE, -np.inf, last / BILLION - self.slack)

    def _forget(self) -> None:
        """Lets go of the ids that are not among the best."""
        self._settle()
        used, at = np.unique(self.at, return_inverse=True)
        self.ids, self.at = [pa.concat_arrays(self.ids).take(pa.array(used))], at.reshape(self.at.shape)
        self.named = len(used)

    def best(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        self._settle()
        ids, some = pa.concat_arrays(self.ids), max(1, 65_536 // self.k)
        for a in range(0, len(self.keys), some):
            i, place = np.nonzero(self.score[a : a + some] > NONE)
            columns = [self.keys.take(pa.array(i + a)), ids.take(pa.array(self.at[a + i, place])), pa.array(self.score[a + i, place] / BILLION)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _searched(batches: Iterator[pa.RecordBatch], names: list[str], dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """Best items of the queries of each cell: a cell's queries come first, then its items by list."""
    cell, asked, best = None, [], None
    for rows in batches:
        if not rows.num_rows:
            continue
        place = rows.column("_cell").to_numpy() * 2 + rows.column("_side").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows.slice(a, b - a)
            if place[a] // 2 != cell:
                if best:
                    yield from best.best(names)
                cell, asked, best = place[a] // 2, [], None
            if place[a] % 2 == 0:
                probes = part.column("_probes")
                bits = None if probes.null_count else np.frombuffer(b"".join(probes.to_pylist()), np.uint8).reshape(part.num_rows, -1)
                asked.append((part.column("_query"), _matrix(part.column("_vector"), dimension), bits))
            elif asked or best:
                if not best:
                    keys, vectors, bits = zip(*asked, strict=True)
                    bits = None if bits[0] is None else np.ascontiguousarray(np.concatenate(bits).T)
                    best = _Nearest(_joined(list(keys)), np.concatenate(vectors), bits, k)
                    asked, keys, vectors, bits = [], None, None, None
                best.see(part.column("_item"), _matrix(part.column("_vector"), dimension), part.column("_row").to_numpy(), part.column("list").to_numpy())
    if best:
        yield from best.best(names)


def _cells(items: int, queries: int, dimension: int, k: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and pieces of items, so that a cell's queries fit a task and its pairs do not keep one for long."""
    pairs = items * queries
    least = -(-queries // max(256, CELL_VALUES // max(dimension, 3 * k)))
    tasks = max(min(3 * cores, -(-pairs // FEW_PAIRS)), -(-pairs // MOST_PAIRS), least, 1)
    if tasks > cores:  # as many for each core
        tasks = -(-tasks // cores) * cores
    blocks = max(least, min(tasks, -(-queries // 4_096)), 1)
    return blocks, max(-(-tasks // blocks), -(-items * dimension // STREAM_VALUES), 1)


def _met(tables: RoundTables, items: DataFrame, queries: DataFrame, item_id: str, query_id: str, dimension: int, k: int) -> DataFrame:
    """The ``k`` best of ``items`` for each of ``queries`` (both with ``_vector``) in each piece of the items.

    Items have a ``list``; queries have ``_probes``, the lists to search as bits, or null for all. A block of queries and a
    piece of the items meet in a cell, which is one task: it holds the queries and lets the items stream by. Rows are dealt
    by their stored number, so equal or null ids are spread.
    """
    if items.schema["_vector"].dataType != queries.schema["_vector"].dataType:
        items, queries = (x.withColumn("_vector", F.col("_vector").cast("array<double>")) for x in (items, queries))
    number, spark = F.monotonically_increasing_id(), items.sparkSession
    order = [item_id, F.xxhash64("_vector")]
    # numbers follow the ids, for ties
    items = tables.store(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", number))
    queries = tables.store(queries.withColumn("_row", number))
    blocks, pieces = _cells(items.count(), queries.count(), dimension, k, spark.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {"_item": items.schema[item_id].dataType, "_query": queries.schema[query_id].dataType}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    columns = ["_vector", "_row", "_cell"]
    left = items.withColumn("_block", each(blocks)).withColumn("_cell", dealt(pieces) * blocks + F.col("_block"))
    left = left.select(*columns, F.lit(1).alias("_side"), "list", F.col(item_id).alias("_item"), none("_query"), F.lit(None).cast("binary").alias("_probes"))
    right = queries.withColumn("_piece", each(pieces)).withColumn("_cell", F.col("_piece") * blocks + dealt(blocks))
    right = right.select(*columns, F.lit(0).alias("_side"), F.lit(0).alias("list"), none("_item"), F.col(query_id).alias("_query"), "_probes")
    met = left.unionByName(right).repartitionById(blocks * pieces, "_cell").sortWithinPartitions("_cell", "_side", "list", "_row")
    names = [query_id, item_id, "score"]
    return met.mapInArrow(lambda batches: _searched(batches, names, dimension, k), _result_schema(items, queries, item_id, query_id))


def cosine_top_k(
    items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, query_vector: str, k: int, batch: int = 2048
) -> DataFrame:
    """Exact cosine top-k of every query over all items, with ``score`` and ``rank`` (ties by item).

    Up to ``batch`` queries go to the tasks that read the items, each of which keeps k candidates per query. More queries
    are dealt to tasks of their own in blocks of bounded size, and the items stream through each (see :func:`_met`). The
    items' most common length is the dimension; null, ragged and non-finite vectors take no part on either side.
    """
    spark = items.sparkSession
    schema = _result_schema(items, queries, item_id, query_id)
    dimension = dimension_of(items, vector)
    asked = queries.select(query_id, F.col(query_vector).cast("array<double>").alias(query_vector)).where(is_usable(query_vector, dimension))
    part = asked.limit(batch + 1).collect()
    if len(part) > batch:
        tables = RoundTables(spark)
        asked = queries.where(is_usable(query_vector, dimension)).select(query_id, _numbers(queries, query_vector, "_vector"))
        left = items.where(is_usable(vector, dimension)).select(item_id, _numbers(items, vector, "_vector"), F.lit(0).alias("list"))
        right = asked.withColumn("_probes", F.lit(None).cast("binary"))
        return _ranked(_met(tables, left, right, item_id, query_id, dimension, k), query_id, item_id, k)
    usable = items.select(item_id, F.col(vector).cast("array<double>").alias(vector)).where(is_usable(vector, dimension))
    kinds = [to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(items.schema[item_id].dataType)]
    out = None
    if part:
        shared = spark.sparkContext.broadcast(([r[0] for r in part], _unit(np.array([r[1] for r in part], dtype=np.float64))))

        def search(batches, shared=shared):
            keys, unit = shared.value
            best_score, best_item = [np.zeros(0)] * len(keys), [np.zeros(0, object)] * len(keys)
            for rows in batches:
                if not rows.num_rows:
                    continue
                order = pc.sort_indices(rows.column(item_id))
                rows = rows.take(order)
                ids = np.array(rows.column(item_id).to_pylist(), dtype=object)
                data = _unit(_matrix(rows.column(vector), dimension))
                for a in range(0, len(keys), QUERY_ROWS):
                    scores = np.round(unit[a : a + QUERY_ROWS] @ data.T, 9)
                    for i, at in _best(scores, k):
                        score = np.append(best_score[a + i], scores[i, at])
                        item = np.append(best_item[a + i], ids[at])
                        keep = sorted(range(len(score)), key=lambda j: (-score[j], item[j]))[:k]
                        best_score[a + i], best_item[a + i] = score[keep], item[keep]
            some = [i for i in range(len(keys)) if len(best_score[i])]
            for a in range(0, len(some), QUERY_ROWS):
                held = some[a : a + QUERY_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in held for _ in best_score[i]], kinds[0]),
                        pa.array([x for i in held for x in best_item[i]], kinds[1]),
                        pa.array(np.concatenate([best_score[i] for i in held])),
                    ],
                    names=[query_id, item_id, "score"],
                )

        out = usable.mapInArrow(search, schema)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return _ranked(out, query_id, item_id, k)


def fit_centres(items: DataFrame, item_id: str, vector: str, lists: int | None = None, rounds: int = 12, sample_values: int = SAMPLE_VALUES) -> np.ndarray:
    """Unit centres of spherical k-means over a bounded sample of the items.

    The sample is the items with the smallest hash of the id, ``sample_values`` numbers in all at most. ``lists`` is the root
    of the number of items if not given, ``MOST_LISTS`` at most.
    """
    dimension = dimension_of(items, vector)
    if not dimension:
        return np.zeros((0, 0))
    usable = items.where(is_usable(vector, dimension))
    lists = min(MOST_LISTS, lists or max(1, round(usable.count() ** 0.5)))
    rows = usable.orderBy(F.xxhash64(item_id), item_id).limit(max(1, sample_values // dimension)).select(F.col(vector).cast("array<double>").alias("v"))
    data = _unit(_matrix(rows.toArrow().column("v"), dimension))
    if not len(data):
        return np.zeros((0, dimension))
    centres = data[:: max(1, len(data) // lists)][:lists].copy()
    for _ in range(rounds):
        near = np.concatenate([(data[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(data), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """Every usable item with the number of its nearest centre (``list``), and the centres."""

    items: DataFrame
    centres: np.ndarray
    item_id: str
    vector: str

    def write(self, path: str) -> None:
        """Items partitioned by list, so that a search for given lists reads only their folders; centres beside them."""
        spark = self.items.sparkSession
        # a list is spread by item, so that a large one is written by several tasks
        spread = F.pmod(F.xxhash64(self.item_id), F.lit(16))
        self.items.repartition("list", spread).write.mode("overwrite").partitionBy("list").parquet(f"{path}/items")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_index(spark, path: str, item_id: str, vector: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return VectorIndex(spark.read.parquet(f"{path}/items"), np.array([r["centre"] for r in rows]), item_id, vector)


def _near(rows: pa.RecordBatch, vector: str, centres: np.ndarray, probes: int, some: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``some`` rows at a time with the numbers of the ``probes`` nearest centres of each."""
    for a in range(0, rows.num_rows, some):
        part = rows.slice(a, some)
        scores = _unit(_matrix(part.column(vector), centres.shape[1])) @ centres.T
        yield part, np.array([at for _, at in _best(scores, probes)]).reshape(part.num_rows, -1)


def _assigned(rows: pa.RecordBatch, vector: str, centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """``rows`` with ``list``, each as often as there are ``probes``, in batches of at most ``CELL_VALUES`` numbers or a row's."""
    count, dimension = centres.shape
    some = max(1, min(4096, CELL_VALUES // max(1, min(probes, count) * dimension), CELL_VALUES // count))
    for part, near in _near(rows, vector, centres, probes, some):
        wide = part.take(pa.array(np.repeat(np.arange(part.num_rows), near.shape[1])))
        yield pa.RecordBatch.from_arrays([*wide.columns, pa.array(near.ravel(), pa.int32())], names=[*rows.schema.names, "list"])


def _probed(rows: pa.RecordBatch, vector: str, centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """``rows`` with ``_probes``: a bit for each centre, set for the ``probes`` nearest ones."""
    for part, near in _near(rows, vector, centres, probes, max(1, min(4096, CELL_VALUES // len(centres)))):
        chosen = np.zeros((part.num_rows, len(centres)), bool)
        np.put_along_axis(chosen, near, True, axis=1)
        bits = pa.array([x.tobytes() for x in np.packbits(chosen, axis=1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns, bits], names=[*rows.schema.names, "_probes"])


def _with_centres(frame: DataFrame, vector: str, centres: np.ndarray, probes: int, added, column: str) -> DataFrame:
    """Rows with the column that ``added`` (:func:`_assigned` or :func:`_probed`) gives them."""
    shared = frame.sparkSession.sparkContext.broadcast(centres)

    def add(batches):
        for rows in batches:
            yield from added(rows, vector, shared.value, probes)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(add, f"{kinds}, {column}")


def build_index(items: DataFrame, item_id: str, vector: str, lists: int | None = None) -> VectorIndex:
    """Inverted-file index: centres learnt on a bounded sample, every usable item in the list of its nearest centre.

    Null, ragged and non-finite vectors are left out (see :func:`is_usable`).
    """
    centres = fit_centres(items, item_id, vector, lists)
    rows = items.select(item_id, _numbers(items, vector, vector))
    if not len(centres):
        return VectorIndex(rows.where("false").withColumn("list", F.lit(0)), centres, item_id, vector)
    listed = _with_centres(rows.where(is_usable(vector, centres.shape[1])), vector, centres, 1, _assigned, "list int")
    return VectorIndex(RoundTables(items.sparkSession).store(listed), centres, item_id, vector)


def search_index(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int | None = None) -> DataFrame:
    """Cosine top-k of every query over the items of its ``probes`` nearest lists, with exact ``score`` and ``rank``.

    A third of the lists is probed if not given; all of them make the search exact. A query carries its lists as bits and is
    dealt once; blocks of queries meet the items, list by list (see :func:`_met`), each list with the queries that probe it.
    """
    item_id, vector, centres = index.item_id, index.vector, index.centres
    schema = _result_schema(index.items, queries, item_id, query_id)
    spark = queries.sparkSession
    if not len(centres):
        return spark.createDataFrame([], schema + ", rank int")
    dimension = centres.shape[1]
    probes = min(len(centres), probes or max(1, -(-len(centres) // 3)))
    asked = queries.where(is_usable(query_vector, dimension)).select(query_id, _numbers(queries, query_vector, "_vector"))
    asked = _with_centres(asked, "_vector", centres, probes, _probed, "_probes binary")
    items = index.items.select(item_id, _numbers(index.items, vector, "_vector"), F.col("list").cast("int").alias("list"))
    return _ranked(_met(RoundTables(spark), items, asked, item_id, query_id, dimension, k), query_id, item_id, k)


def recall_per_query(found: DataFrame, exact: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """``recall`` of each query of ``exact``: the share of its items that ``found`` has too."""
    hits = found.select(query_id, item_id, F.lit(1.0).alias("hit")).distinct()
    return exact.join(hits, [query_id, item_id], "left").groupBy(query_id).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
