"""Best-fit packing of token pieces with certified bin counts.

Texts become token ids word by word: white space never joins words in the tokenizer, so each task encodes every distinct
word once. Full pieces are sequences of their own. The others are dealt to groups of bounded size; each packs its pieces
best-fit decreasing and holds the bin count against lower bounds from dual-feasible functions. Bins that a group's bound
does not certify, and the emptiest bin of each, give their pieces back; these are dealt anew and packed again.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import Words, chunks, flat, lean
from gridpulse.llm.licenses import LOWER
from gridpulse.llm.spark import pinned, received, sent, texts_of

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", grp long, bin long, offset long, settled boolean"


LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
MARKS = np.zeros(256, bool)
MARKS[33:127] = True
MARKS[[39, *range(48, 58), *range(65, 91), *range(97, 123)]] = False


def encoding_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Stretches that the tokenizer never joins: it drops white space, lowers case and parts letters from marks.

    Apostrophes keep their neighbours (contractions), and so does any word with the opening of a special token.
    """
    lower = LOWER[buf]
    letter, mark = LETTERS[lower], MARKS[lower]
    cut = np.zeros(len(buf), bool)
    cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    special = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    if len(special):
        whole = Words(buf, offsets)
        for i in np.unique(np.searchsorted(whole.starts, special, side="right") - 1).tolist():
            a, b = whole.starts[i], whole.ends[i]
            lower[a:b], cut[a:b] = buf[a:b], False
    return Words(lower, offsets, cuts=np.flatnonzero(cut))


class WordIds:
    """Token ids of words; each distinct word is encoded once and kept while there are at most ``most``."""

    def __init__(self, tokenizer, most: int = 1_000_000):
        self.tokenizer, self.most = tokenizer, most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and how many each word has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self._clear()
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        fresh = np.flatnonzero(self.hashes[place] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(fresh):
            s, e = words.starts[at[fresh]].tolist(), words.ends[at[fresh]].tolist()
            data = words.buf.tobytes()
            self._learn(distinct[fresh], [data[x:y].decode() for x, y in zip(s, e, strict=True)])
        place = np.searchsorted(self.hashes, distinct)[back]
        sizes = self.sizes[place]
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.pool[np.repeat(self.starts[place], sizes) + offset], sizes


def piece_task(shared, capacity: int, end_id: int):
    def task(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode = WordIds(Tokenizer.from_str(received(shared)))
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                buf, offsets = flat(part.column("text"))
                words = encoding_words(buf, offsets)
                ids, sizes = encode(words)
                ends = np.concatenate([[0], np.cumsum(sizes)])[words.first]
                doc_ids = part.column("doc_id").to_pylist()
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                tail = np.array([end_id], "<u4")
                for doc_id, a, b in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.concatenate([ids[a:b], tail]).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        row = (doc_id, piece, start, len(cut), zlib.crc32(cut))
                        for values, value in zip(out.values(), row, strict=True):
                            values.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}
                )

    return task


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, best-fit decreasing, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, rooms = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        rooms[b] = left
        if left:
            waiting[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(rooms, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most: int = 24) -> int:
    """Least number of bins by dual-feasible functions: size, rounding by k, and dropping small pieces."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, most + 1):
        grown = (k + 1) * size
        value = np.where(grown % capacity == 0, k * size, grown // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    total, number = np.cumsum(count * size), np.cumsum(count)
    for small in range(1, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - small])
        middle = int(total[capacity - small] - total[small - 1])
        best = max(best, big - (-middle // capacity))
    return best


def pack_task(capacity: int, exchange: bool):
    def task(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, rooms = best_fit(lengths, capacity)
        settled = np.ones(len(rooms), bool)
        if exchange:
            gap = len(rooms) - lower_bound(lengths, capacity)
            free = np.argsort(-rooms, kind="stable")[: 1 + 4 * gap]
            settled[free[rooms[free] > 0]] = False
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32", "grp"]).append_column(
            "bin", pa.array(bins)
        ).append_column("offset", pa.array(offsets)).append_column("settled", pa.array(settled[bins]))

    return task


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every text's token ids, each text closed by ``end_id`` and cut only every ``capacity`` ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = sent(docs.sparkSession, file.read())
    return texts_of(docs).mapInArrow(lean(piece_task(shared, capacity, end_id)), PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group: int = 20_000, rounds: int = 3) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` ids as the rounds find."""
    pieces = pinned(pieces).withColumn("_at", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") >= capacity)
    done = [full.select(*[n.split()[0] for n in PIECE_SCHEMA.split(", ")], (-1 - F.col("_at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity)
    for turn in range(rounds):
        groups = -(-max(1, rest.count()) // group)
        last = turn == rounds - 1 or groups == 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("_at", F.lit(turn)), F.lit(groups)))
        placed = pinned(dealt.groupBy("grp").applyInArrow(lean(pack_task(capacity, not last)), PLACED_SCHEMA))
        number = (F.lit(turn) * F.lit(1 << 60)).cast("long") + F.col("grp") * F.lit(1 << 24) + F.col("bin")
        done.append(
            placed.where("settled").select(*[n.split()[0] for n in PIECE_SCHEMA.split(", ")], number.alias("sequence_id"), "offset")
        )
        if last:
            break
        rest = placed.where(~F.col("settled")).withColumn("_at", F.monotonically_increasing_id())
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group: int = 20_000, rounds: int = 3
) -> DataFrame:
    """Token pieces of all documents packed into sequences.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts are the
    end id alone. Repeated rows are packed once each, null ids are kept, other columns are ignored and an empty table
    gives an empty result. Sequence ids are unique, not dense.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, group, rounds)
