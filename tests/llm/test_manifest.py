"""The Merkle manifest against a plain version."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridpulse.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, place string, path string, members int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, fan):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings(levels, i, fan):
    for level in levels[:-1]:
        a = i // fan * fan
        yield level[a:i], level[i + 1 : a + fan]
        i //= fan


def plain(rows, fan):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"], digest(*[encoded(r[c]) for c in manifest.FIELDS]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in sources[s]], fan)
    top = tree([trees[s][-1][0] for s in names], fan)
    for k, s in enumerate(names):
        for i, (doc_id, leaf, r) in enumerate(sources[s]):
            path = [*siblings(trees[s], i, fan), *siblings(top, k, fan)]
            h = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r["text"] is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                h = digest(*[encoded(r[c]) for c in manifest.FIELDS[:-1]], encoded(text))
            for before, after in path:
                h = digest(*before, h, *after)
            root = top[-1][0]
            yield doc_id, leaf, trees[s][-1][0], root, digest(*[x for a, b in path for x in a + b]), h, h == root


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


AWKWARD = [
    (None, "a", None, None, None), (None, "a", "en", 3, "Abc"), (None, "a", "en", 3, "Abc"), (7, "a", "en", 0, ""), (7, "a", "en", 2, "Él"),
    (8, None, "en", 5, "HELLO"), (9, None, "de", 5, "ÄÖ ü"), (10, "", "en", 5, "x"), (12, "Z", "en", 50_000, "LONG " * 10_000),
    (13, "é", "", 1, "É"), (10, "", "en", 5, "x"), (-4, "only", "en", 2, "AB"),
]


def check(spark, rows, fan):
    docs = frame(spark, rows)
    got = manifest.proof_rows(manifest.build_manifest(docs, fan)).collect()
    want = list(plain([r.asDict() for r in docs.collect()], fan))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("fan", [2, 16])
def test_awkward_rows_and_repeated_rows(spark, fan):
    got = check(spark, AWKWARD, fan)
    assert len(got) == len(AWKWARD) and len({r["root"] for r in got}) == 1
    assert {r["verified"] for r in got if r["doc_id"] is None} == {True}


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_run_lengths_with_a_hot_source(spark, n):
    check(spark, [(i, "hot" if i % 3 else f"s{i}", "en", i, f"Text {i}") for i in range(n)], 16)


def test_only_tampered_texts_with_capitals_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 4, "Caps" if i % 2 else "none") for i in range(200)]
    got = {r["doc_id"]: r["verified"] for r in check(spark, rows, 16)}
    assert [i for i, ok in got.items() if not ok] and all(
        ok == (not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0)) for i, ok in got.items()
    )


def test_single_row_is_its_own_root(spark):
    (row,) = check(spark, [(1, "a", "en", 1, "x")], 16)
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == digest()


def test_empty_table(spark):
    built = manifest.build_manifest(frame(spark, []))
    assert manifest.proof_rows(built).count() == 0 and built.root().count() == 0 and built.nodes().count() == 0


def test_nodes_rebuild_the_root(spark):
    built = manifest.build_manifest(frame(spark, AWKWARD), 4)
    nodes = built.nodes()
    assert nodes.where("tree = 'source' and level = 0").count() == len(AWKWARD)
    top = nodes.where("tree = 'roots'").groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()
    assert [r["n"] for r in top] == [6, 2, 1]
    assert built.root().first()["root"] == nodes.where("tree = 'roots' and level = 2").first()["digest"]
