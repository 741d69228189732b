"""Language identification with bit-sliced Bloom filters of byte n-grams.

Every slot of the filter holds a bit mask of languages, so one lookup (the masks of a few slots, ANDed) gives all
languages that contain an n-gram. Hits are counted per language, corrected by the filter's false-positive rate, and the
language with the largest share decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.arrays import chunks, flat, lean, mix
from gridpulse.llm.spark import received, sent

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
COUNT_SCHEMA = "lang string, gram long, n long"
GRAM = 4
PAD = 3

LETTER = np.full(256, 0x20, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def grams_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four-byte n-grams with a letter of all texts (padded with blanks), and where each text's begin."""
    texts = len(offsets) - 1
    spread = np.full(len(buf) + PAD * (texts + 1), 0x20, np.uint8)
    number = np.repeat(np.arange(texts), np.diff(offsets))
    spread[np.arange(len(buf)) + PAD * (number + 1)] = LETTER[buf]
    wide = spread.astype(np.uint32)
    n = len(spread) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
    code = wide[:n] | (wide[1 : n + 1] << 8) | (wide[2 : n + 2] << 16) | (wide[3 : n + 3] << 24)
    real = code != 0x20202020
    bounds = np.minimum(offsets + PAD * np.arange(texts + 1), n)
    first = np.concatenate([[0], np.cumsum(real)])[bounds]
    return code[real], first


def count_task(batches):
    held: dict[str, list] = {}

    def merged(pairs):
        code = np.concatenate([c for c, _ in pairs])
        count = np.concatenate([n for _, n in pairs])
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        cut = np.flatnonzero(np.diff(code.astype(np.int64), prepend=-1))
        return code[cut], np.add.reduceat(count, cut) if len(cut) else count

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            code, first = grams_of(*flat(part.column("text")))
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                of = np.repeat(langs == lang, np.diff(first))
                values, n = np.unique(code[of], return_counts=True)
                held.setdefault(lang, []).append((values, n))
                if len(held[lang]) > 16:
                    held[lang] = [merged(held[lang])]
    for lang, pairs in held.items():
        code, n = merged(pairs)
        for a in range(0, len(code), 1 << 16):
            size = len(code[a : a + (1 << 16)])
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * size, pa.string()),
                    "gram": pa.array(code[a : a + size].astype(np.int64)),
                    "n": pa.array(n[a : a + size].astype(np.int64)),
                }
            )


def held_out(column):
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(True))


class Filter:
    """Bit-sliced Bloom filter: a language mask in each of ``2 ** bits`` slots, ``hashes`` slots for an n-gram."""

    def __init__(self, grams: dict[str, np.ndarray], bits: int, hashes: int):
        self.langs, self.bits, self.hashes = sorted(grams), bits, hashes
        self.words = -(-max(1, len(self.langs)) // 64)
        self.table = np.zeros((self.words, 1 << bits), np.uint64)
        for i, lang in enumerate(self.langs):
            for slot in self.slots(grams[lang]):
                self.table[i // 64, slot] |= np.uint64(1 << (i % 64))
        fill = np.array([self.bit(self.table, i).mean() for i in range(len(self.langs))])
        self.false_rate = fill**hashes

    def slots(self, code: np.ndarray):
        h = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        low = np.uint64((1 << self.bits) - 1)
        return [(h >> np.uint64(self.bits * k % 44)) & low for k in range(self.hashes)]

    @staticmethod
    def bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def shares(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains (texts x languages)."""
        masks = None
        for slot in self.slots(code):
            got = self.table[:, slot]
            masks = got if masks is None else masks & got
        n = np.diff(first)
        out = np.zeros((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            hits = np.diff(np.concatenate([[0], np.cumsum(self.bit(masks, i).astype(np.int64))])[first])
            rate = self.false_rate[i]
            out[:, i] = np.maximum(0, (hits - n * rate) / (1 - rate)) / np.maximum(n, 1) if rate < 1 else 0
        return out


def fit(docs: DataFrame, per_language: int, grams: int, least_share: float, bits: int, hashes: int) -> Filter:
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(1.0)
    for lang, n in sizes.items():
        if n > per_language:
            rate = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(rate)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    counts = drawn.select("text", "lang").mapInArrow(lean(count_task), COUNT_SCHEMA)
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 3")
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    best = ranked.where(F.col("place") <= grams).select("lang", "gram", "n").toPandas()
    best["rate"] = best["n"] / best.groupby("lang")["n"].transform("sum")
    best = best[best["rate"] >= least_share * best.groupby("gram")["rate"].transform("max")]
    return Filter({k: g["gram"].to_numpy() for k, g in best.groupby("lang")}, bits, hashes)


def predict_task(shared):
    def task(batches):
        model = received(shared)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                buf, offsets = flat(part.column("text"))
                code, first = grams_of(buf, offsets)
                letter = np.concatenate([[0], np.cumsum((LETTER[buf] != 0x20) & (buf < 128))])
                has = np.diff(letter[offsets]) > 0
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode()))
                if model.langs:
                    share = model.shares(code, first)
                    top = share.argmax(axis=1)
                    total = share.sum(axis=1)
                    score = np.where(has & (total > 0), share[np.arange(len(top)), top] / np.maximum(total, 1e-12), 0.0)
                    lang = np.where(has, np.array(model.langs, object)[top], "und")
                else:
                    score, lang = np.zeros(len(has)), np.full(len(has), "und", object)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "lang_pred": pa.array(lang.tolist(), pa.string()),
                        "score": pa.array(score, pa.float64()),
                    }
                )

    return task


def identify_languages(
    docs: DataFrame,
    per_language: int = 8_000,
    grams: int = 30_000,
    least_share: float = 0.15,
    bits: int = 20,
    hashes: int = 3,
) -> DataFrame:
    """Predicted language of every text: ``doc_id, held_out, lang_pred, score``.

    The filter is fit on documents with a language that are not held out, at most about ``per_language`` of each
    language (drawn by a hash of the id), keeping the ``grams`` commonest n-grams of each whose rate is at least
    ``least_share`` of their highest rate in any language. Predictions read the text alone.

    A null text or one without a letter gives ``und`` and 0, as does every text where nothing could be learned. Ties go
    to the first language in alphabetical order; a null id counts as held out; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = sent(spark, fit(plain, per_language, grams, least_share, bits, hashes))
    asked = plain.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(lean(predict_task(shared)), SCHEMA)
