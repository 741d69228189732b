"""The likeness of op9_imatch_fingerprints: from the fingerprints alone, against the Jaccard similarity of lexicon terms."""

from pathlib import Path

import numpy as np
import pytest

from gridpulse.llm import fingerprints
from gridpulse.llm.spark import texts_of
from gridpulse.llm.workload import table

FOLDER = "/root/testdata/sf0.001"


def terms(texts, lexicon):
    h, first = fingerprints.Printer(lexicon).kept_terms([t.encode() for t in texts])
    return [set(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")
def test_likeness_comes_from_the_strings_and_misses_no_edited_copy(spark):
    documents = table(spark, FOLDER, "documents")
    lexicon = fingerprints.lexicon(texts_of(documents), 0.001, 0.1)
    docs = sorted((r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect())
    own = [t for _, t in docs]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, own[1:] + own[:1], strict=True)]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(documents, each=1 << 16).collect()}
    prints = fingerprints.prints_of_texts([rows[i]["fingerprint"] for i, _ in docs])
    changed = fingerprints.prints_of_texts([rows[i]["edited_fingerprint"] for i, _ in docs])
    assert np.allclose(fingerprints.likeness(prints, changed), [rows[i]["near_edited"] for i, _ in docs])
    assert np.allclose(fingerprints.likeness(prints, np.roll(prints, -1, axis=0)), [rows[i]["near_next"] for i, _ in docs])
    plain = fingerprints.Printer(lexicon)
    assert (plain.prints([t.encode() for t in own]) == prints).all() and (plain.prints([t.encode() for t in edited]) == changed).all()
    true = np.array([len(a & b) / len(a | b) for a, b in zip(terms(own, lexicon), terms(edited, lexicon), strict=True)])
    got = np.array([rows[i]["near_edited"] for i, _ in docs])
    near = true >= 0.3
    print(f"error: mean {np.abs(got - true).mean():.3f}, largest {np.abs(got - true).max():.3f}; least likeness of {near.sum()} near pairs {got[near].min():.2f}")
    assert near.sum() > 50 and got[near].min() > 0.1
    assert np.abs(got - true).mean() < 0.06 and np.abs(got - true).max() < 0.3


def test_texts_without_lexicon_terms(spark):
    rows = [(1, "alpha beta"), (2, "gamma delta"), (3, ""), (4, None), (5, "!?"), (6, "--"), (7, "--")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["near_next"] == 1 for i in range(1, 7)] == [False, False, True, False, False, True]
    assert max(got[i]["near_next"] for i in (1, 2, 4, 5)) < 0.1
    assert len({got[i]["fingerprint"] for i in range(1, 8)}) == 5


def test_equal_fingerprints_only_of_equal_terms():
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(5_000)]
    texts = [" ".join(rng.choice(words, 30)).encode() for _ in range(400)]
    prints = fingerprints.Printer(np.zeros(0, np.uint64)).prints([*texts, *texts])
    assert (prints[:400] == prints[400:]).all() and len({p.tobytes() for p in prints}) == len(set(texts))
    assert (fingerprints.likeness(prints[:400], prints[400:]) == 1).all()


@pytest.mark.parametrize("n", [1, 3, 40, 700, 9_000])
def test_likeness_of_short_and_long_pairs(n):
    rng = np.random.default_rng(n)
    printer = fingerprints.Printer(np.zeros(0, np.uint64))
    errors = []
    for kept in (0.0, 0.3, 0.5, 0.9):
        for _ in range(3):
            own = [f"w{x}" for x in rng.choice(10**9, 2 * n, replace=False)]
            shared = int(n * kept)
            a, b = own[:n], own[:shared] + own[n : 2 * n - shared]
            prints = printer.prints([" ".join(a).encode(), " ".join(b).encode()])
            errors.append(abs(fingerprints.likeness(prints[:1], prints[1:])[0] - shared / (2 * n - shared)))
    assert np.mean(errors) < 0.06 and max(errors) < 0.25
