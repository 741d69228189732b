"""I-Match fingerprints: distinct terms of a middling document frequency, hashed under randomised lexicons.

Document frequencies are counted over all documents. The lexicon keeps terms inside the band; since each of its terms
stands in at least ``low`` of all documents, it has at most (mean distinct terms of a document) / ``low`` terms however
large the corpus is. Each randomised lexicon is a random part of it, and a fingerprint holds, for each, the hash of the
sorted distinct terms of the text that it keeps, besides their number. Lexicons come in series: a series starts with the
whole lexicon, and each next one keeps about half of the terms of the one before. Two texts differ under a lexicon that
keeps a term of only one of them, so the place in its series from which on they agree tells how many such terms there
are. The likeness of two texts is read from their two fingerprints and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import NULL_ID, Words, chunks, flat, hash_spans, lean, mix
from gridpulse.llm.licenses import LOWER, NOT_WORD
from gridpulse.llm.spark import received, sent, text_bytes, texts_of

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
SERIES, SIZES = 64, 16
"""Series of lexicons, and lexicons of a series: the last keeps one term in 2**15."""
PRINT_BYTES = 8 + SERIES * SIZES
TRAILING = np.array([SIZES - 1, *(min(SIZES - 1, (x & -x).bit_length() - 1) for x in range(1, 1 << 16))])
"""Trailing zero bits of 16-bit numbers."""


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, ascending within it, and where each text's begin."""
    buf = LOWER[buf]
    words = Words(buf, offsets, NOT_WORD)
    h = hash_spans(buf, words.starts, words.ends)
    text = words.text(0)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def frequency_task(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h = np.concatenate([x for x, _ in held])
        n = np.concatenate([x for _, x in held])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        return (h[cut], np.add.reduceat(n, cut)) if len(cut) else (h, n)

    def rows():
        h, n = merged()
        held.clear()
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(h[a : a + (1 << 16)].view(np.int64)), "n": pa.array(n[a : a + (1 << 16)].astype(np.int64))}
            )

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            h, _ = terms_of(*flat(part.column("text")))
            held.append(np.unique(h, return_counts=True))
            if len(held) > 16:
                held[:] = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield from rows()
    if held:
        yield from rows()


def lexicon(texts: DataFrame, low: float, high: float) -> np.ndarray:
    """Sorted hashes of the terms whose share of all documents lies in the band."""
    total = texts.count()
    counts = texts.select("text").mapInArrow(lean(frequency_task), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= max(2.0, high * total))).select("term")
    return np.sort(kept.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Printer:
    """Fingerprints of texts under the randomised lexicons."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms

    def kept_terms(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon terms of each text, and where each text's begin.

        A text without any is read under all its terms, one without terms as a single term of its own.
        """
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, first = terms_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        bare = np.flatnonzero(np.diff(first) == 0)
        if len(bare):
            own = np.array([xxhash.xxh64_intdigest(texts[i], 1) for i in bare], np.uint64)
            h, first = np.insert(h, first[bare], own), first + np.searchsorted(bare, np.arange(len(first)))
        kept = np.zeros(len(h), bool)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            kept = self.terms[at] == h
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        kept |= (np.bincount(text, kept, len(texts)) == 0)[text]
        return h[kept], np.concatenate([[0], np.cumsum(kept)])[first]

    def prints(self, texts: list[bytes]) -> np.ndarray:
        """A row of ``PRINT_BYTES`` per text: the number of its terms, then a one-byte hash for each lexicon."""
        h, first = self.kept_terms(texts)
        out = np.zeros((len(texts), PRINT_BYTES), np.uint8)
        count = np.diff(first)
        out[:, :8] = count.astype(">u8").view(np.uint8).reshape(-1, 8)
        text = np.repeat(np.arange(len(texts)), count)
        # a sum of mixed hashes of distinct terms is the same whatever their order, so sorting is implied; it stays exact
        value = (mix(h + np.uint64(1)) >> np.uint64(32)).astype(np.float64)
        cell = text * SIZES
        for series in range(SERIES):
            if series % 4 == 0:  # one hash draws for four series
                drawn = mix(h ^ np.uint64((series + 1) * 0x9E3779B97F4A7C15 % 2**64))
            # trailing zero bits say how many lexicons of the series keep a term
            last = TRAILING[drawn >> np.uint64(16 * (series % 4)) & np.uint64(0xFFFF)]
            total = np.bincount(cell + last, value, len(texts) * SIZES).reshape(-1, SIZES)
            total = np.cumsum(total[:, ::-1], axis=1)[:, ::-1].astype(np.uint64)
            at = 8 + series * SIZES
            out[:, at : at + SIZES] = (mix(total) >> np.uint64(56)).astype(np.uint8)
        return out


def texts_of_prints(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes().hex() for p in prints])


def prints_of_texts(texts: list[str]) -> np.ndarray:
    return np.array([np.frombuffer(bytes.fromhex(t), np.uint8) for t in texts]).reshape(len(texts), PRINT_BYTES)


def likeness(a: np.ndarray, b: np.ndarray, steps: int = 24) -> np.ndarray:
    """Likeness (0 to 1) of the fingerprints of each row: the Jaccard similarity of the terms that they make most likely.

    With D terms that only one text has, a series differs last at lexicon m with the chance
    (1 - 2**-(m + 1))**D - (1 - 2**-m)**D. D is the most likely number, not under the difference of the two term counts
    nor over their sum. Equal fingerprints have likeness 1.
    """
    n = len(a)
    counts = [np.ascontiguousarray(x[:, :8]).view(">u8").ravel().astype(np.float64) for x in (a, b)]
    every, least = counts[0] + counts[1], np.maximum(np.abs(counts[0] - counts[1]), 1)
    unlike = (a[:, 8:] != b[:, 8:]).reshape(n, SERIES, SIZES)
    last = np.where(unlike.any(axis=2), SIZES - 1 - unlike[:, :, ::-1].argmax(axis=2), 0)
    seen = np.zeros((n, SIZES))
    np.add.at(seen, (np.repeat(np.arange(n), SERIES), last.ravel()), 1)
    upto = np.append(np.log1p(-(0.5 ** np.arange(1, SIZES))), 0.0)  # the last lexicon stands for all smaller ones

    def best(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grid = lo[:, None] * (np.maximum(hi, lo) / lo)[:, None] ** np.linspace(0, 1, steps)
        whole = np.exp(grid[:, :, None] * upto)
        chance = np.diff(whole, axis=2, prepend=0.0)
        fit = (seen[:, None, :] * np.log(np.maximum(chance, 1e-300))).sum(axis=2).argmax(axis=1)
        row = np.arange(n)
        return grid[row, fit], grid[row, np.maximum(fit - 1, 0)], grid[row, np.minimum(fit + 1, steps - 1)]

    _, lo, hi = best(least, every)
    differ, _, _ = best(lo, hi)
    out = np.maximum(every - differ, 0) / np.maximum(every + differ, 1)
    return np.where((a == b).all(axis=1), 1.0, out)


def print_task(shared):
    """Rows of one range of ids in order; ``own`` is false for the first document of the next range."""

    def task(batches):
        printer = Printer(received(shared))
        held: list[tuple] = []  # rows that wait for their next document

        def emit(rows, following):
            texts = [r[1] for r in rows]
            after = [*texts[1:], following]
            edited = []
            for a, b in zip(texts, after, strict=True):
                half = len(a) // 2
                edited.append(a[: len(a) - half] + b[:half])
            raw = [t.encode() for t in [*texts, following]]
            changed = [t.encode() for t in edited]
            n = len(rows)
            own, other = printer.prints(raw), printer.prints(changed)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                    "fingerprint": texts_of_prints(own[:n]),
                    "edited_fingerprint": texts_of_prints(other),
                    "near_edited": pa.array(likeness(own[:n], other)),
                    "near_next": pa.array(likeness(own[:n], own[1:])),
                }
            )

        bucket, size = None, 0
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                columns = (part.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "own"))
                for b, doc_id, text, own in zip(*columns, strict=True):
                    if b != bucket:
                        if held:  # a range with no next document follows itself, as in a table of one document
                            yield emit(held, held[0][1])
                            held.clear()
                        bucket, size = b, 0
                    if own:
                        held.append((doc_id, text or ""))
                        size += len(held[-1][1])
                        if len(held) > 1 and size > 1 << 20:
                            yield emit(held[:-1], held[-1][1])
                            held[:] = held[-1:]
                            size = len(held[0][1])
                    elif held:
                        yield emit(held, text or "")
                        held.clear()
        if held:
            yield emit(held, held[0][1])

    return task


def fingerprints(docs: DataFrame, low: float = 0.001, high: float = 0.1, each: int = 12 << 20, most_ranges: int = 2_000) -> DataFrame:
    """I-Match fingerprints of every text and of its edited text.

    The edited text is the text with its last half (rounded down) of code points replaced by the first as many of the
    next document in ascending ``doc_id``; the last document is followed by the first. Terms are lower-cased (A-Z) runs
    of letters, digits and non-ASCII characters; the lexicon has those in ``low`` to ``high`` of all documents. Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the last two are the
    :func:`likeness` of the two fingerprints and of the document's and the next one's.

    Null text is empty; a null id comes first; rows that share an id are ordered by text. A single document follows
    itself. Equal texts have equal fingerprints; a text without a lexicon term is printed under all its terms, one without
    terms under itself. Long texts are printed whole. Other columns are ignored, an empty table gives an empty result. Documents are dealt to ranges of ids of about ``each`` bytes, at most
    ``most_ranges`` of them: beyond that the ranges grow, which costs no memory since rows stream through in order.
    """
    spark = docs.sparkSession
    plain = texts_of(docs).withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    ranges = int(min(most_ranges, max(1, -(-text_bytes(plain) // each))))
    cuts = []
    if ranges > 1:
        found = plain.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100_000)).first()[0]
        cuts = sorted(set(found or []))
    bucket = _steps(cuts, F.col("key"))
    dealt = plain.withColumn("bucket", bucket)
    heads = {r["bucket"]: r["head"] for r in dealt.groupBy("bucket").agg(F.min("key").alias("head")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    targets = F.array(F.struct(F.col("bucket").alias("to"), F.lit(True).alias("own")))
    if before:
        to = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("key"))
        again = F.array(F.struct(to.alias("to"), F.lit(False).alias("own")))
        targets = F.when(F.col("key").isin(list(before)), F.concat(targets, again)).otherwise(targets)
    sent_to = dealt.select("doc_id", "key", "text", F.explode(targets).alias("t")).select(
        F.col("t.to").alias("bucket"), F.col("t.own").alias("own"), "key", "doc_id", "text"
    )
    shared = sent(spark, lexicon(plain, low, high))
    # the next range's head comes last, also where the first document of all follows the last one
    sorted_rows = sent_to.repartition(max(1, len(order)), "bucket").sortWithinPartitions("bucket", F.col("own").desc(), "key", "text")
    return sorted_rows.select("bucket", "doc_id", "text", "own").mapInArrow(lean(print_task(shared)), SCHEMA)


def _steps(cuts: list[int], key):
    """Nested comparisons, as deep as the logarithm of the number of cuts."""

    def step(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]), step(mid + 1, hi)).otherwise(step(lo, mid))

    return step(0, len(cuts))
