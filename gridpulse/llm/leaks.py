"""Benchmark decontamination by latent semantic retrieval.

Texts are read once, for the places of the words that benchmark items use, and from then on are overlapping passages of
these words, weighted by TF-IDF with frequencies from all passages of the corpus. A randomised SVD over every passage gives a latent space: Spark tasks reduce the passages to
pair counts of item words (A^T A), and the SVD's products with them run in Spark tasks too; passages near an item there (cosine) are candidates, as are
verbatim copies whatever their cosine, found by the rarest five-word run of each item. Each candidate is then settled exactly: by the weight of the
longest common subsequence of item and text, and, for paraphrases, by how much of the item's answer the text has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.arrays import Words, chunks, flat, gram_hashes, hash_spans, lean, slices, trim, unpacked
from gridpulse.llm.jaccard import with_row_key
from gridpulse.llm.licenses import LOWER, NOT_WORD
from gridpulse.llm.spark import pinned, received, sent, stored, summed, text_bytes, texts_of

HALF = 24
GRAM = 5
FAR = 255
HIT_SCHEMA = "doc_id long, t1 long, t2 long, words long, ids binary, gaps binary, far binary"
LEAK_SCHEMA = "doc_id long, t1 long, t2 long, item_id long, cosine double, lcs double, answer double, first_word long, last_word long"


def item_words(text: str) -> tuple[np.ndarray, int]:
    """Word hashes of an item, and at which word its answer (last sentence, else last third) begins."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(LOWER[data], np.array([0, len(data)]), NOT_WORD)
    h = words.hashes()
    raw = data.tobytes().rstrip(b" \n.?!")
    stop = max(raw.rfind(b". "), raw.rfind(b"? "), raw.rfind(b"! "), raw.rfind(b"\n"))
    answer = int(np.searchsorted(words.starts, stop)) if stop >= 0 else len(h) * 2 // 3
    return h, min(answer, max(0, len(h) - 1))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Items:
    """A block of benchmark items over their own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]], least_words: int):
        read = [(item, *item_words(text)) for item, text in rows]
        read = [r for r in read if len(r[1]) >= least_words]
        self.ids = [r[0] for r in read]
        self.vocabulary = np.unique(np.concatenate([r[1] for r in read])) if read else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, r[1]) for r in read]
        self.sizes = np.array([len(words) for words in self.words])
        self.answers = [r[2] for r in read]
        self.idf = self.heavy = np.ones(len(self.vocabulary))
        self.latent, self.vectors = None, None

    def weigh(self, counts: dict[int, int], passages: int) -> None:
        frequency = np.array([counts.get(i, 0) for i in range(len(self.vocabulary))], float)
        self.idf = np.log((passages + 2) / (frequency + 1))
        # every word counts in the search, however common, so that items of ordinary words have a latent vector too
        self.heavy = self.idf
        self.totals = np.array([max(float(self.idf[words].sum()), 1e-12) for words in self.words])
        whole = np.repeat(np.arange(len(self.words)), [len(words) for words in self.words]) * len(self.vocabulary)
        self.codes, self.times = np.unique(whole + np.concatenate(self.words), return_counts=True)
        self.mark()

    def most_common(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Weight of the words that each item shares with hits ``lo`` to ``hi``, however they are placed."""
        size = hi - lo
        some, first = np.repeat(np.arange(len(item)), size), np.cumsum(size) - size
        word = ids[np.repeat(lo - first, size) + np.arange(len(some))]
        code = item[some] * len(self.vocabulary) + word
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        own = np.flatnonzero(self.codes[place] == code)
        both, times = np.unique(some[own] * len(self.codes) + place[own], return_counts=True)
        some, place = both // len(self.codes), both % len(self.codes)
        weight = self.idf[self.codes[place] % len(self.vocabulary)] * np.minimum(times, self.times[place])
        return np.bincount(some, weight, minlength=len(item))

    def mark(self) -> None:
        """The rarest run of ``GRAM`` words of each item: any verbatim copy holds it."""
        runs, at = [], []
        for words in self.words:
            total = np.concatenate([[0.0], np.cumsum(self.idf[words])])
            start = int(np.argmax(total[GRAM:] - total[:-GRAM])) if len(words) >= GRAM else 0
            at.append(start)
            runs.append(gram_hashes(words[start : start + GRAM].astype(np.uint64), min(GRAM, len(words)))[0])
        self.run_order = np.argsort(np.array(runs, np.uint64), kind="stable")
        self.runs, self.run_at = np.array(runs, np.uint64)[self.run_order], np.array(at)
        self.first_stretch = np.searchsorted(np.array([i for i, _ in self.stretches()]), np.arange(len(self.words)))

    def copies(self, text: np.ndarray, word: np.ndarray, ids: np.ndarray):
        """Text, item and first word of each verbatim copy among the hits of a batch."""
        whole = {}
        for size in sorted({min(GRAM, len(w)) for w in self.words}):
            grams = gram_hashes(ids.astype(np.uint64), size)
            n = len(grams)
            joined = (text[:n] == text[size - 1 :]) & (word[size - 1 :] - word[:n] == size - 1)
            lo, hi = np.searchsorted(self.runs, grams, "left"), np.searchsorted(self.runs, grams, "right")
            for k in np.flatnonzero(joined & (hi > lo)).tolist():
                for item in self.run_order[lo[k] : hi[k]].tolist():
                    words, a = self.words[item], k - int(self.run_at[item])
                    b = a + len(words)
                    if min(GRAM, len(words)) != size or a < 0 or b > len(ids) or text[a] != text[b - 1]:
                        continue
                    if word[b - 1] - word[a] == len(words) - 1 and (ids[a:b] == words).all():
                        whole.setdefault((int(text[a]), item), int(word[a]))
        return ((t, i, w) for (t, i), w in whole.items())

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all stretches, and where each stretch begins."""
        parts = [words for _, words in self.stretches()]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])

    def place(self, latent: np.ndarray) -> None:
        """Latent vectors of the stretches, of length 1; words are weighted by IDF."""
        self.latent = (latent * self.heavy[:, None]).astype(np.float32)
        ids, first = self.rows()
        self.vectors = unit(np.add.reduceat(self.latent[ids], first, axis=0))
        stretch = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        self.weights = np.zeros((len(first), len(self.vocabulary)), np.float32)
        self.weights[stretch, ids] = self.heavy[ids]
        self.masses = self.weights.sum(axis=1)

    def stretches(self):
        """Every item, cut into stretches of at most a passage, half overlapping."""
        for i, words in enumerate(self.words):
            for a in range(0, max(1, len(words) - HALF), HALF):
                yield i, words[a : a + 2 * HALF]


class Finder:
    """Vocabulary places of a batch's words."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[vocabulary & np.uint64((1 << 18) - 1)] = True

    def __call__(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, word number and vocabulary id of each hit, and the number of words of each text."""
        buf, offsets = flat(part.column("text"))
        buf = LOWER[buf]
        words = Words(buf, offsets, NOT_WORD)
        h = hash_spans(buf, words.starts, words.ends)
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 18) - 1)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), max(0, len(self.vocabulary) - 1))
        sure = self.vocabulary[place] == h[at]
        at, ids = at[sure], place[sure]
        text = np.searchsorted(words.first, at, side="right") - 1
        return text, at - words.first[text], ids, np.diff(words.first)


def id_kind(vocabulary: np.ndarray):
    return np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values[bounds[i]:bounds[i + 1]]``, row by row."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def hit_task(shared):
    """Hits of each text: vocabulary ids, and words since the hit before (a byte; ``FAR`` of them or more are listed apart)."""

    def task(batches):
        vocabulary = received(shared)
        find = Finder(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                text, word, ids, n = find(part)
                bounds = np.searchsorted(text, np.arange(len(n) + 1))
                gaps = np.diff(word, prepend=0)
                begins = bounds[:-1][np.diff(bounds) > 0]
                gaps[begins] = word[begins]
                far = np.flatnonzero(gaps >= FAR)
                columns = {c: part.column(c) for c in ("doc_id", "t1", "t2")} | {
                    "words": pa.array(n, pa.int64()),
                    "ids": binaries(ids.astype(id_kind(vocabulary)), bounds),
                    "gaps": binaries(np.minimum(gaps, FAR).astype(np.uint8), bounds),
                    "far": binaries(gaps[far], np.searchsorted(far, bounds)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return task


def hits(vocabulary: np.ndarray, batches, most: int):
    """Slices of the batches with their hits, as :class:`Finder` gives them, out of stored hits or of texts.

    A slice has about ``most`` bytes of text, or a fourth as many words (also those that are no hits).
    """
    find, kind = Finder(vocabulary), id_kind(vocabulary)
    for batch in batches:
        if "text" in batch.schema.names:
            for part in chunks(batch, "text", most):
                yield part, *find(part)
            continue
        for part in slices(batch, np.cumsum(np.append(0, batch.column("words").to_numpy())), most // 4):
            ids, gaps = unpacked(part.column("ids"), kind).astype(np.int64), unpacked(part.column("gaps"), np.uint8).astype(np.int64)
            gaps[gaps == FAR] = unpacked(part.column("far"), np.int64)
            _, bounds = flat(part.column("gaps"))
            text, passed = np.repeat(np.arange(part.num_rows), np.diff(bounds)), np.cumsum(np.append(0, gaps))
            yield part, text, passed[1:] - passed[bounds[text]], ids, part.column("words").to_numpy()


def frequency_task(shared):
    def task(batches):
        vocabulary = received(shared)
        size = len(vocabulary)
        total, passages = np.zeros(size, np.int64), 0
        for _, text, word, ids, n in hits(vocabulary, batches, 1 << 20):
            halves = -(-n // HALF)
            passages += int(halves.sum())
            block = (np.cumsum(halves) - halves)[text] + word // HALF
            codes = np.sort(block * size + ids)
            total += np.bincount(codes[np.diff(codes, prepend=-1) > 0] % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(total[some], passages), pa.int64())}
        )

    return task


def half_blocks(text: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half passage of each hit, first half passage of each text, and text of each half passage."""
    halves = -(-n // HALF)
    first = np.cumsum(halves) - halves
    return first[text] + word // HALF, first, np.repeat(np.arange(len(n)), halves)


def sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the rows of each group; ``group`` ascends."""
    out = np.zeros((groups, rows.shape[1]), rows.dtype)
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    if len(cut):
        out[group[cut]] = np.add.reduceat(rows, cut, axis=0)
    return out


def word_sums(latent: np.ndarray, ids: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """Sum of the latent rows of each block's words; blocks ascend and are short, so all are added to a word at a time."""
    start = np.searchsorted(block, np.arange(blocks + 1))
    count = np.diff(start)
    order = np.argsort(-count, kind="stable")
    start, count = start[:-1][order], count[order]
    sums = np.zeros((blocks, latent.shape[1]), latent.dtype)
    for step in range(int(count[0]) if blocks else 0):
        some = int(np.searchsorted(-count, -step, side="left"))
        sums[:some] += np.take(latent, ids[start[:some] + step], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def pair_task(shared, held: int):
    """Counts of word pairs of the same half passage: the upper half of A^T A before weights, a row of A being a half passage.

    A word's own entry counts its hits, and twice its pairs with itself. About ``held`` pairs wait for each reduction, and
    what is reduced is added up in the task until it has more than twice as many unlike pairs.
    """

    def task(batches):
        items = received(shared)
        size = len(items.vocabulary)
        waiting: list[np.ndarray] = []
        known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def reduced():
            nonlocal known, times
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            # two ascending lists, which a stable sort merges
            codes, n = np.concatenate([known, codes]), np.concatenate([times, n])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            known, times = codes[first], np.add.reduceat(n, first)

        def rows():
            nonlocal known, times
            i, j, n = known // size, known % size, times
            known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "n": pa.array(n, pa.int64())})

        for _, text, word, ids, n in hits(items.vocabulary, batches, 1 << 18):
            block, _, _ = half_blocks(text, word, n)
            big = np.flatnonzero(items.heavy[ids] > 0)
            ids, block = ids[big], block[big]
            waiting.append(ids * size + ids)
            at = np.arange(len(ids))
            for step in range(1, min(HALF, len(ids))):
                # blocks ascend, so only hits with a hit of their block at the step before can have one here
                at = at[: np.searchsorted(at, len(ids) - step)]
                at = at[block[at + step] == block[at]]
                if not len(at):
                    break
                a, b = ids[at], ids[at + step]
                same = np.flatnonzero(a == b)
                waiting += [np.minimum(a, b) * size + np.maximum(a, b), a[same] * size + a[same]]
                if sum(map(len, waiting)) >= held:
                    reduced()
                    if len(known) > 2 * held:
                        yield rows()
        if waiting:
            reduced()
        if len(known):
            yield rows()

    return task


def product_task(shared, scale: float):
    """One task's share of (A^T A) W from pair counts, scaled, as raw floats."""

    def task(batches):
        heavy, w = received(shared)
        out = np.zeros(w.shape, np.float32)
        for batch in batches:
            i, j, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ijn")
            rows, at = np.unique(i, return_inverse=True)
            for a in range(0, len(rows), 64):
                own = np.flatnonzero((at >= a) & (at < a + 64))
                counts = np.zeros((len(rows[a : a + 64]), len(heavy)), np.float32)
                counts[at[own] - a, j[own]] = n[own] * heavy[i[own]] * heavy[j[own]]
                out[rows[a : a + 64]] += counts @ w
                counts[at[own] - a, j[own]] *= i[own] != j[own]  # the lower half mirrors the upper one
                out += counts.T @ w[rows[a : a + 64]]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([(scale * out).tobytes()], pa.binary())})

    return task


def latent_space(items: Items, found: DataFrame, rank: int, tasks: int, rounds: int, item_share: float) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of all passages of all texts (their stored hits) and of all items.

    The corpus is scaled so that the items' squared weight is ``item_share`` of its own, whatever its size.
    """
    spark = found.sparkSession
    size = len(items.vocabulary)
    width = min(size, rank + 16)
    model = sent(spark, items)
    pairs = found.select("words", "ids", "gaps", "far").mapInArrow(lean(pair_task(model, 1 << 20)), "i long, j long, n long")
    # at most one row for each pair of item words, however large the corpus
    pairs = pinned(pairs.groupBy("i", "j").agg(F.sum("n").alias("n")).repartition(tasks, "i").sortWithinPartitions("i", "j"))
    model.destroy()
    few = pairs.coalesce(tasks)  # a sum a task, so their number must not follow the settings
    # one row a word, in one job: an iterator would take one for each partition
    own = sum(r["n"] * float(items.heavy[r["i"]]) ** 2 for r in pairs.where("i = j").select("i", "n").collect())
    ids, first = items.rows()
    stretch = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    order = np.argsort(ids, kind="stable")
    scale = float((items.heavy[ids] ** 2).sum()) / (item_share * own) if own else 0.0

    def product(w: np.ndarray) -> np.ndarray:
        out = np.empty(w.shape)
        for a in range(0, w.shape[1], 16):  # the items' words by all columns would be the driver's largest array
            y = sums(w[ids, a : a + 16] * items.heavy[ids, None], stretch, len(first))
            out[:, a : a + 16] = sums((y[stretch] * items.heavy[ids, None])[order], ids[order], size)
        shared = sent(spark, (items.heavy, w.astype(np.float32)))
        total = summed(few.mapInArrow(lean(product_task(shared, scale)), "sums binary"), np.float64)  # one of fixed size a task
        shared.destroy()
        return out + total.reshape(out.shape) if len(total) else out

    w = np.random.default_rng(7).normal(size=(size, width))
    for _ in range(rounds):
        w, _ = np.linalg.qr(product(w))
    values, vectors = np.linalg.eigh(w.T @ product(w))
    return w @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def common(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two id sequences."""
    best = np.zeros(len(text) + 1)
    for word in item.tolist():
        step = best[:-1] + np.where(text == word, weight[word], 0.0)
        best[1:] = np.maximum(best[1:], step)
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def leak_task(shared, cosine: float, whole: float, part: float, answer_share: float):
    def reached(items, item, text, word, n, doc, start):
        """First and last hit that a copy of the item can have near word ``start`` of its text, for all candidates."""
        reach = items.sizes[item] * 3 // 2
        wide = int(n.max()) + 1
        place = text * wide + word
        lo = np.searchsorted(place, doc * wide + np.maximum(start - reach, 0))
        return lo, np.searchsorted(place, doc * wide + np.minimum(start + 2 * HALF + reach, wide - 1))

    def possible(items, item, lo, hi, ids):
        """Which candidates share enough words with their item to be settled: a bound, so it has some slack."""
        ok, least = np.zeros(len(item), bool), min(whole, part) * items.totals[item] - 1e-6
        turn = np.cumsum(hi - lo) >> 20  # about a million hits at a time
        edges = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(item))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            ok[a:b] = items.most_common(item[a:b], lo[a:b], hi[a:b], ids) >= least[a:b]
        return ok

    def settle(items, item, pos, ids, lo, hi):
        words = items.words[item]
        own = np.isin(ids[lo:hi], words)
        at, text = pos[lo:hi][own], ids[lo:hi][own]
        # the text must hold the item within twice its length: take the heaviest such stretch
        total = float(items.totals[item])
        gain = np.concatenate([[0], np.cumsum(items.idf[text])])
        ends = np.searchsorted(at, at + 2 * len(words))
        if not len(at):
            return None
        best = int(np.argmax(gain[ends] - gain[:-1]))
        at, text = at[best : ends[best]], text[best : ends[best]]
        known, mine = np.unique(words, return_counts=True)
        theirs = np.bincount(np.searchsorted(known, text), minlength=len(known))
        tail = np.unique(words[items.answers[item] :])
        answer = float(items.idf[np.intersect1d(tail, text)].sum()) / max(float(items.idf[tail].sum()), 1e-12)
        # no common subsequence outweighs the words that both have; what can't reach its share is not aligned
        needed = part if answer >= answer_share else whole
        if float((items.idf[known] * np.minimum(mine, theirs)).sum()) < needed * total - 1e-9:
            return None
        lcs = common(words, text, items.idf) / total
        return (lcs, answer, int(at[0]), int(at[-1])) if lcs >= needed else None

    def candidates(items, passage, ids, begin, end):
        """Passages and stretches that are near, and of whose words the passage has enough weight to pass the checks."""
        flat_weights = items.weights.ravel()
        passed = np.concatenate([[0.0], np.cumsum(items.heavy[ids])])
        gain = passed[end] - passed[begin]  # no stretch has more weight in a passage than the passage itself
        for a in range(0, len(passage), 4096):
            k, j = np.nonzero(passage[a : a + 4096] @ items.vectors.T >= cosine)
            k += a
            size = end[k] - begin[k]
            some = np.flatnonzero((size > 0) & (gain[k] >= 0.799 * part * items.masses[j]))
            k, j, size = k[some], j[some], size[some]
            for b in range(0, len(k), 50_000):
                kk, jj, nn = k[b : b + 50_000], j[b : b + 50_000], size[b : b + 50_000]
                first = np.cumsum(nn) - nn
                at = np.repeat(begin[kk] - first, nn) + np.arange(nn.sum())
                weight = np.add.reduceat(np.take(flat_weights, np.repeat(jj * len(items.vocabulary), nn) + ids[at]), first)
                ok = weight >= 0.8 * part * items.masses[jj]
                yield kk[ok], jj[ok]

    def task(batches):
        items = received(shared)
        stretch_of = np.array([i for i, _ in items.stretches()])
        out: list[tuple] = []

        def rows():
            names = [c.split()[0] for c in LEAK_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.int64()] * 2
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_pydict({n: pa.array(list(v), k) for n, k, v in zip(names, kinds, columns, strict=True)})
            out.clear()
            return batch

        for rows_read, text, word, ids, n in hits(items.vocabulary, batches, 1 << 20):
            if not len(ids):
                continue
            block, first, owner = half_blocks(text, word, n)
            big = np.flatnonzero(items.heavy[ids] > 0)
            half = word_sums(items.latent, ids[big], block[big], len(owner))
            passage = half.copy()
            same = np.flatnonzero(owner[1:] == owner[:-1])
            passage[same] += half[same + 1]
            passage = unit(passage)
            begin = np.searchsorted(block[big], np.arange(len(owner) + 1))
            end = begin[1:].copy()
            end[same] = begin[same + 2]
            begin = begin[:-1]
            doc_ids, t1, t2 = (rows_read.column(c) for c in ("doc_id", "t1", "t2"))
            place = lambda t: (doc_ids[t].as_py(), t1[t].as_py(), t2[t].as_py())  # noqa: B023, E731
            copied = set()
            for t, item, w in items.copies(text, word, ids):
                copied.add((t, item))
                near = float(passage[int(first[t]) + w // HALF] @ items.vectors[items.first_stretch[item]])
                span = (w, w + len(items.words[item]) - 1)
                out.append((*place(t), items.ids[item], min(1.0, near), 1.0, 1.0, *span))
            settled: dict[tuple, tuple | None] = {}
            for kk, jj in candidates(items, passage, ids[big], begin, end):
                docs, near_items = owner[kk], stretch_of[jj]
                lo, hi = reached(items, near_items, text, word, n, docs, (kk - first[docs]) * HALF)
                ok = np.flatnonzero(possible(items, near_items, lo, hi, ids))
                for k, j, doc, item, *stretch in zip(*(v[ok].tolist() for v in (kk, jj, docs, near_items, lo, hi)), strict=True):
                    if (doc, item) in copied:
                        continue
                    # half passages whose reach has the same hits are settled together
                    if (doc, item, *stretch) not in settled:
                        settled[doc, item, *stretch] = settle(items, item, word, ids, *stretch)
                    if got := settled[doc, item, *stretch]:
                        near = float(passage[k] @ items.vectors[j])
                        out.append((*place(doc), items.ids[item], min(1.0, near), *got))
            if out:
                yield rows()

    return task


def item_blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct items with a text, streamed to the driver in blocks of about ``words`` words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL AND text IS NOT NULL")
    # the iterator takes a job for each partition, so these follow the texts and not the settings
    parts = 1 + text_bytes(rows) // (4 << 20)
    block, size = [], 0
    for r in rows.distinct().coalesce(parts).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + 1
        if size >= words:
            yield sorted(block)
            block, size = [], 0
    if block:
        yield sorted(block)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, cosine, lcs, answer, first_word, last_word``.

    One row per document and item, with the best passage; rows that share an id, also a null one, are one document here.
    See :func:`leaking_texts` for the search and its ``options``.
    """
    return _best(leaking_texts(docs, benchmark, **options), ["doc_id", "item_id"])


def _best(found: DataFrame, keys: list[str]) -> DataFrame:
    passage = F.struct("cosine", "lcs", "answer", "first_word", "last_word")
    best = F.max_by(passage, F.struct("lcs", "cosine", -F.col("first_word"))).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, "b.*")


def leaking_texts(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.3,
    whole: float = 0.7,
    part: float = 0.5,
    answer_share: float = 0.6,
    rank: int = 160,
    item_share: float = 0.15,
    least_words: int = 5,
    block_words: int = 20_000,
) -> DataFrame:
    """Rows that hold a benchmark item: columns of :func:`leaks`, with the text hashes ``t1, t2`` of ``jaccard.with_row_key``.

    Passages of 48 words, one every 24, are compared with every item. Candidates with a latent cosine of at least
    ``cosine``, and all verbatim copies of an item's words, leak if a common subsequence has the share ``whole`` of the
    item's IDF weight, or ``part`` of it together with ``answer_share`` of the weight of the item's answer. The latent space
    (``rank`` dimensions) is fit on all passages and all items, the items with ``item_share`` of the corpus's weight. Items
    come in blocks of about ``block_words`` words, any number of them.

    One row per id, text and item, with the best passage (ties: the first). Null or empty texts and items of fewer than
    ``least_words`` words leak nothing. Very long texts are read whole, a few at a time. A null id is kept as null, and unlike
    texts of one id stay apart. Repeated documents or items give each row once; other columns are ignored; empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    texts = with_row_key(texts_of(docs)).where(F.length("text") > 0).select("doc_id", "t1", "t2", "text")
    out = None
    for block in item_blocks(benchmark, block_words):
        items = Items(block, least_words)
        if not items.ids:
            continue
        # the texts are read once; their hits stay on the executors' disks while the block is at work
        vocabulary = sent(spark, items.vocabulary)
        hit = texts.mapInArrow(lean(hit_task(vocabulary)), HIT_SCHEMA).persist(StorageLevel.DISK_ONLY)
        counts = hit.select("words", "ids", "gaps", "far").mapInArrow(lean(frequency_task(vocabulary)), "term long, n long")
        counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
        counted = {r["term"]: r["n"] for r in counts.collect()}
        items.weigh(counted, counted.get(-1, 0))
        items.place(latent_space(items, hit, rank, tasks=6, rounds=2, item_share=item_share))
        trim()
        model = sent(spark, items)
        found = stored(hit.mapInArrow(lean(leak_task(model, cosine, whole, part, answer_share)), LEAK_SCHEMA))
        hit.unpersist()
        for used in (vocabulary, model):
            used.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], LEAK_SCHEMA)
    return _best(out, ["doc_id", "t1", "t2", "item_id"])
