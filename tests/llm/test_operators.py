"""Corpus operators against plain versions, on test tables and on awkward fixtures."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.llm import captures, fingerprints, jaccard, languages, leaks, licenses, packing, quality, substrings, suffixes
from gridpulse.llm.workload import QUERIES, table, tokenizer_path
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")
random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choice(VOCABULARY) for _ in range(3000))
SHARED = " ".join(random.choice(VOCABULARY) for _ in range(60))


def edited(text, every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split()))


FIXTURE = [
    (1, SHARED), (2, f"before {SHARED} after"), (3, SHARED), (4, edited(SHARED, 40)), (5, edited(SHARED, 9)),
    (6, LONG), (7, f"{LONG} end"), (8, " ".join(LONG.split()[500:900])), (9, None), (10, ""), (11, " \n\t "),
    (12, "one"), (13, "same " * 40), (14, "same " * 60), (15, "é" * 130), (16, "x" + "é" * 130), (17, "a b c d"),
    (18, "Released under the MIT License. the mit license apache license version 2.0, CC-BY-NC"), (19, f"{SHARED}\n{SHARED}"),
]
CLASHING = "doc_id long, text string, bucket string, kept string, key string, n_words string, lang string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "b", "k", "y", "n", None) for i, t in FIXTURE]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents")


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def rows(frame, *columns):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("source", ["awkward", "documents"])
def test_substring_dedup(request, source):
    frame = request.getfixturevalue(source)
    got = rows(substrings.substring_dedup(frame), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute.substring_dedup(texts(frame))


@pytest.mark.parametrize("source", ["awkward", "documents"])
def test_suffix_dedup(request, source):
    frame = request.getfixturevalue(source)
    got = rows(suffixes.suffix_dedup(frame, memory=1 << 12), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert got == brute.suffix_dedup(texts(frame))


@pytest.mark.parametrize("source", ["awkward", "documents"])
def test_near_duplicates(request, source):
    frame = request.getfixturevalue(source)
    got = rows(jaccard.near_duplicates(frame, limit=3), "doc_id", "class_id", "copy_of", "n_links", "n_copies")
    assert got == brute.near_duplicates(texts(frame))


def test_near_duplicates_of_one_large_group(spark):
    base = [random.choice(VOCABULARY) for _ in range(120)]
    docs = []
    for i in range(90):
        own = list(base)
        own[random.randrange(120)] = f"own{i}"
        docs.append((i, " ".join(own)))
    got = rows(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), limit=20), "doc_id", "class_id", "copy_of", "n_links", "n_copies")
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("source", ["awkward", "documents"])
def test_licence_places(request, source):
    frame = request.getfixturevalue(source)
    got = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    for i, t in texts(frame):
        r = got[i]
        own = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert own == brute.licence_places(t, licenses.BASE)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_licence_chain_bridges_a_changed_word(spark):
    notice = licenses.TEMPLATES["gpl-3"][0].replace("licensed", "published")
    r = licenses.license_scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first()
    assert r["labels"] == "gpl-3" and 0.75 <= r["score"] < 1 and r["n_base"] == 0


def test_language_held_out_accuracy(spark, documents):
    got = languages.identify_languages(documents)
    joined = got.join(documents.select("doc_id", "lang"), "doc_id")
    right = joined.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0


def test_language_of_texts_without_letters(spark, documents):
    odd = documents.limit(40).select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(900, None, "en"), (901, "", None), (902, "12 .. 3", "en"), (None, "the", None)], "doc_id long, text string, lang string")
    )
    got = {r["doc_id"]: r for r in languages.identify_languages(odd).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert got[None]["held_out"] and got[None]["lang_pred"] != "und"


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    got = quality.with_prediction(quality.quality_scores(table(spark, folder, "documents"), labels))
    joined = got.join(labels, "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_without_labels_or_text(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(awkward, none).collect()} == {0.5}


@pytest.mark.parametrize("group", [8, 20_000])
def test_packing(spark, awkward, group):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(awkward, path, capacity=256, group=group).collect()
    own, sequences = {}, {}
    for r in got:
        own.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, t in FIXTURE:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cut = [ids[a : a + 256] for a in range(0, len(ids), 256)]
        want = [(k, 256 * k, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for k, c in enumerate(cut)]
        assert sorted(own[i]) == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    if group > len(got):  # groups of eight pieces cannot fill their bins as well
        lengths = np.array([r["length"] for r in got])
        assert sum(lengths) == total and len(sequences) <= packing.lower_bound(lengths, 256) + 1


def test_lower_bound_and_best_fit():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([], dtype=int), 10) == 0
    bins, offsets, rooms = packing.best_fit(np.array([5, 4, 6, 5]), 10)
    assert rooms.tolist() == [0, 0] and sorted(offsets.tolist()) == [0, 0, 5, 6]


def test_captures_round_trip(spark):
    page = "<p>" + "text\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(3, "http://a/x", page), (2, "http://b/é\r\nX: y", page), (5, None, page), (None, "u", page), (7, "http://c", "short"),
             (8, "http://d", "short"), (9, "http://e", None), (3, "http://a/x", page), (10, "v", "x" * 300_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = captures.captures(frame, archive_bytes=1 << 16, keep_payload=True).collect()
    assert len(got) == len(pages)
    by = sorted((r["page_id"] if r["page_id"] is not None else 99, r["response"]["record_type"], r["refers_to_page"]) for r in got)
    assert by == sorted([(2, "response", None), (3, "revisit", 2), (3, "revisit", 2), (5, "revisit", 2), (99, "revisit", 2),
                         (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None)])
    for r in got:
        assert r["metadata"] is not None and r["request"] is not None
        if r["page_id"] == 2:
            assert bytes(r["response"]["payload"]).decode() == page


def test_fingerprints(spark, documents):
    import hashlib

    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents, each=1 << 16).collect()}
    docs = sorted(texts(documents))
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(a or "") // 2
        text = (a or "")[: len(a or "") - half] + (b or "")[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a or ""), hashlib.sha256(text.encode()).hexdigest())
    prints = {}
    for i, a in docs:
        assert prints.setdefault(a, got[i]["fingerprint"]) == got[i]["fingerprint"]
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 5 * mean("near_next")


def test_fingerprints_of_awkward_rows(spark, awkward):
    odd = awkward.unionByName(spark.createDataFrame([(None, "null id", *"bkyn", None), (1, SHARED, *"bkyn", None)], CLASHING))
    got = fingerprints.fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted([*(str(i) for i, _ in FIXTURE), "None", "1"])
    texts_by = {i: t for i, t in FIXTURE}
    assert all(r["n_chars"] == len(texts_by[r["doc_id"]] or "") for r in got if r["doc_id"] is not None)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert fingerprints.fingerprints(awkward.where("doc_id = 1")).first()["near_next"] == 1


def test_leaks(spark, documents):
    benchmark = table(spark, FOLDER, "benchmark")
    items = benchmark.collect()
    want = {(i, b["item_id"]) for i, t in texts(documents) for b in items if b["text"] in (t or "")}
    paraphrase = " ".join(w for k, w in enumerate(items[3]["text"].split()) if k % 9 != 4)
    more = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame([(90_000, f"{LONG} {paraphrase} {LONG}"), (90_001, None), (90_002, LONG)], "doc_id long, text string")
    )
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(more, benchmark).collect()}
    assert got == want | {(90_000, items[3]["item_id"])}


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for frame in (
        substrings.substring_dedup(empty), suffixes.suffix_dedup(empty), jaccard.near_duplicates(empty), licenses.license_scan(empty),
        languages.identify_languages(empty), quality.quality_scores(empty, labels), packing.pack_documents(empty, tokenizer_path()),
        fingerprints.fingerprints(empty), leaks.leaks(empty, benchmark), captures.captures(pages),
    ):
        assert frame.count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = [(1, SHARED), (1, SHARED), (2, SHARED), (2, f"x {SHARED}"), (None, SHARED), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.substring_dedup(frame).collect()
    assert len(got) == 6 and {r["n_removed"] for r in got if r["doc_id"] == 1} == {60}
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0]
    cut = suffixes.suffix_dedup(frame).collect()
    size = len(SHARED.encode())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in cut) == sorted(
        [("1", size, size), ("1", size, size), ("2", size, size), ("2", size + 2, size), ("None", size, 0), ("None", 0, 0)]
    )
    assert jaccard.near_duplicates(frame).count() == 6
    assert packing.pack_documents(frame, tokenizer_path()).count() == 6


def plain_repeats(docs, units, size, within):
    """Which units of each row go: windows that start in a row with a smaller id, or further left in the same row."""
    first = {}
    own = [units(t) for _, t in docs]
    rank = [(i is not None, i or 0) for i, _ in docs]
    for k, seq in enumerate(own):
        for j in range(len(seq) - size + 1):
            key = seq[j : j + size]
            first[key] = min(first.get(key, rank[k]), rank[k])
    out = []
    for k, seq in enumerate(own):
        gone, seen = set(), set()
        for j in range(len(seq) - size + 1):
            key = seq[j : j + size]
            if first[key] < rank[k] or (within and key in seen):
                gone.update(range(j, j + size))
            seen.add(key)
        out.append((docs[k][0], len(seq), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shared", [None, 7])
def test_many_unlike_texts_with_one_id(spark, shared):
    """5,000 rows of one id keep what only they repeat, and lose what a smaller id has."""
    rng = random.Random(3)
    line = [" ".join(rng.choice(VOCABULARY) for _ in range(15)) for _ in range(40)]
    docs = [(shared, f"{' '.join(rng.choice(VOCABULARY) for _ in range(8))} {rng.choice(line)} {rng.choice('xyz')}") for _ in range(5_000)]
    docs += [(-5, line[0]), (-5, line[1]), (9, line[2]), (9, line[3] + " and " + line[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.substring_dedup(frame).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert got == plain_repeats(docs, lambda t: tuple(brute.WORD.findall(t)), 13, False)
    got = sorted((tuple(r) for r in suffixes.suffix_dedup(frame, 60).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert got == plain_repeats(docs, lambda t: t.encode(), 60, True)


@pytest.mark.parametrize("phrase", ["terms of service apply", "one two three four five six seven eight nine ten"])
def test_common_phrase_spreads_over_anchors(spark, phrase):
    """A phrase in every unlike text anchors no more blocks than rare grams do, and the results stay those of all pairs."""
    from gridpulse.llm import blocks

    rng = random.Random(8)
    pick = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    again = [pick(30) for _ in range(5)]
    docs = [(i, f"{pick(14)} {phrase} {pick(14)} {rng.choice(again) if i % 4 == 0 else ''} {phrase} {pick(9)}") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substrings.substring_dedup(frame, crowd=100).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert got == plain_repeats(docs, lambda t: tuple(brute.WORD.findall(t)), 13, False)
    got = sorted((tuple(r) for r in suffixes.suffix_dedup(frame, crowd=100).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert got == plain_repeats(docs, lambda t: t.encode(), 100, True)
    most = []
    for crowd in (10**9, 100):
        common = blocks.common_grams(frame, substrings.word_units, 13, 4, 1 << 20, crowd)
        units, first = substrings.word_units(frame.coalesce(1).toArrow())
        anchors = blocks.Cutter(13, 4, common)(units, first)[0]
        most.append(np.unique(anchors, return_counts=True)[1].max())
    assert most[0] >= 100 and most[1] < most[0] / 4


def test_quality_of_one_labelled_id_with_many_rows(spark, documents):
    """Rows of one labelled id teach once, so what goes to the driver stays bounded."""
    labels = table(spark, FOLDER, "labels")
    sent = quality.quality_scores(documents, labels, most=50).orderBy("doc_id").select("score").collect()
    known = labels.where("quality is not null and crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    twice = documents.unionByName(documents.where(F.col("doc_id") == known).crossJoin(spark.range(500)).drop("id"))
    again = quality.quality_scores(twice, labels, most=50).dropDuplicates(["doc_id"]).orderBy("doc_id").select("score").collect()
    assert [r[0] for r in again] == pytest.approx([r[0] for r in sent], abs=1e-6)


def test_suffix_order():
    from gridpulse.llm.induced import suffix_order

    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (40, 3), (400, 2), (900, 5)):
        text = np.append(rng.integers(1, k, n), 0).astype(np.int16)
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        for memory in (64, 1 << 20):
            assert suffix_order(text, 258, 10**6, memory).tolist() == want


def test_registered_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
