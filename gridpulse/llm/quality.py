"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Words hash into a fixed number of rows. A word's vector is the sum of the sparse ternary index vectors of its
neighbours, gathered in Spark tasks over a bounded sample of labelled documents. A document is the mean of its words'
vectors beside the mean index vectors of its word shapes. Two dense layers, trained in numpy, give a logit, and a
temperature fit on labelled documents kept out of the training calibrates it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import Words, chunks, flat, lean, trim
from gridpulse.llm.languages import held_out
from gridpulse.llm.spark import pinned, received, sent, summed

SCHEMA = "doc_id long, held_out boolean, score double"
ROWS, WIDTH, SHAPES = 1 << 14, 64, 512
REACH = 2


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: eight of the entries are 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, WIDTH), np.float32)
    for k in range(8):
        out[np.arange(rows), rng.integers(0, WIDTH, rows)] = 1 if k % 2 else -1
    return out


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of every word, its shape and the first word of each text.

    A shape says which kinds of character a word has, how many marks it ends in, its length and whether it repeats.
    """
    words = Words(buf, offsets)
    h = words.hashes()
    s, e = words.starts, words.ends

    def count(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([s, e])], axis=0)[0] if len(s) else s

    upper = count((buf >= 65) & (buf <= 90))
    lower = count((buf >= 97) & (buf <= 122) | (buf >= 128))
    digit = count((buf >= 48) & (buf <= 57))
    size = e - s
    marks = size - upper - lower - digit
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][words.first[:-1] < len(h)]] = 0
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
    shape = np.minimum(np.log2(np.maximum(size, 1)), 7).astype(np.int64)
    shape = shape * 64 + case * 16 + np.minimum(marks, 3) * 4 + (lower > 0) * 2 + (digit > 0)
    shape = np.where(same > 0, SHAPES - 1, shape)
    return (h % np.uint64(ROWS)).astype(np.int64), shape, words.first


def vector_task(batches):
    """Context sums of one task's documents, a row of raw floats."""
    index = index_vectors(ROWS, 1)
    total = np.zeros((ROWS, WIDTH), np.float32)
    for batch in batches:
        for part in chunks(batch, "text", 1 << 19):
            row, _, first = tokens(*flat(part.column("text")))
            if not len(row):
                continue
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.argsort(row, kind="stable")
            near = np.zeros((len(row), WIDTH), np.float32)
            for step in range(1, REACH + 1):
                ok = np.flatnonzero(text[step:] == text[:-step])
                near[ok] += index[row[ok + step]]
                near[ok + step] += index[row[ok]]
            ordered = row[order]
            cut = np.flatnonzero(np.diff(ordered, prepend=-1))
            total[ordered[cut]] += np.add.reduceat(near[order], cut, axis=0)
    yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


class Model:
    """Word vectors, two layers and a temperature."""

    def __init__(self, vectors: np.ndarray):
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = (vectors / np.maximum(norm, 1e-6)).astype(np.float32)
        self.shapes = index_vectors(SHAPES, 2)
        self.layers, self.center, self.scale, self.temperature, self.bias = None, 0.0, 1.0, 1.0, 0.5

    def pooled(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean word vector and mean shape vector of each text; zeros for a text without words."""
        row, shape, first = tokens(buf, offsets)
        n = np.diff(first)
        out = np.zeros((len(n), 2 * WIDTH), np.float32)
        filled = np.flatnonzero(n)
        if len(filled):
            out[filled, :WIDTH] = np.add.reduceat(self.vectors[row], first[filled], axis=0)
            out[filled, WIDTH:] = np.add.reduceat(self.shapes[shape], first[filled], axis=0)
        return out / np.maximum(n, 1).astype(np.float32)[:, None]

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return (np.tanh(((x - self.center) / self.scale) @ w1 + b1) @ w2 + b2).ravel()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, hidden: int, epochs: int) -> None:
        """Adam on the rows not in ``keep``; the temperature comes from those in ``keep``."""
        self.bias = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or len(set(y.tolist())) < 2:
            return
        fit, held = ~keep, keep if keep.sum() >= 10 else ~keep
        self.center, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        rng = np.random.default_rng(0)
        p = [rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, 1)), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        xs, ys, step = (x[fit] - self.center) / self.scale, y[fit][:, None], 0
        for _ in range(epochs):
            order = rng.permutation(len(xs))
            for a in range(0, len(xs), 256):
                part = order[a : a + 256]
                xb, yb = xs[part], ys[part]
                h = np.tanh(xb @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yb) / len(part)
                dh = d @ p[2].T * (1 - h * h)
                grads = [xb.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = [(p[0], p[1]), (p[2], p[3])]
        z, t = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def pool_task(shared):
    def task(batches):
        model = received(shared)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                x = model.pooled(*flat(part.column("text")))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "quality": part.column("quality"),
                        "x": pa.array([v.tobytes() for v in x], pa.binary()),
                    }
                )

    return task


def score_task(shared, carried: bool):
    def task(batches):
        model = received(shared)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                score = model.scores(model.pooled(*flat(part.column("text"))))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "score": pa.array(score.astype(np.float64), pa.float64()),
                    }
                    | ({"carried": part.column("carried")} if carried else {})
                )

    return task


def fit(docs: DataFrame, labels: DataFrame, most: int, tasks: int, hidden: int, epochs: int) -> Model:
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    # the labelled ids with the least hash: a bounded sample that every run draws alike
    drawn = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # each task makes one table of vectors, so there are a few tasks whatever the cluster's settings
    # one text an id, so that the rows are bounded too
    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.min_by(F.struct("text", "quality"), F.struct(F.xxhash64("text"), F.length("text"))).alias("r")
    )
    sample = pinned(texts.select("doc_id", "r.text", "r.quality")).coalesce(tasks)
    sums = summed(sample.select("text").mapInArrow(lean(vector_task), "sums binary"))  # one of fixed size a task
    model = Model(sums.reshape(ROWS, WIDTH) if len(sums) else np.zeros((ROWS, WIDTH), np.float32))
    shared = sent(spark, model)
    rows = sample.mapInArrow(lean(pool_task(shared)), "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if rows:
        x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1)
        y = np.array([r["quality"] for r in rows], np.float32)
        model.train(x, y, np.array([r["doc_id"] * 2654435761 % 8 == 0 for r in rows]), hidden, epochs)
    shared.destroy()
    trim()
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 12_000,
    tasks: int = 4,
    hidden: int = 32,
    epochs: int = 12,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Probability that ``labels.quality`` is 1 for every text: ``doc_id, held_out, score``.

    Learns from at most ``most`` labelled documents (a bounded sample by a hash of the id) whose crc32 of the id, modulo
    5, is not 0. A score depends on the text alone.

    Null and empty texts are scored as a document without words. Rows without a usable label teach nothing; contrary
    labels of one id count as 0; of unlike texts with one id, the one of least hash teaches; without labels of both kinds every score is the mean label (0.5 if there is none). A
    null id counts as held out; repeated rows score alike. Columns named in ``carry`` come back, whatever their names,
    in the struct ``carried``; others are ignored.
    """
    spark = docs.sparkSession
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    plain = docs.select(*own)
    shared = sent(spark, fit(plain, labels, most, tasks, hidden, epochs))
    if carry:
        own.append(F.struct(*carry).alias("carried"))
    asked = docs.select(*own).withColumn("held_out", held_out(F.col("doc_id")))
    kind = f", carried {dict(asked.dtypes)['carried']}" if carry else ""
    return asked.mapInArrow(lean(score_task(shared, bool(carry))), SCHEMA + kind)


def with_prediction(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
