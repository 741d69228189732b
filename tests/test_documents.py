import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridpulse.functions.text import generated_id, plain_text, slug, tokens
from gridpulse.operators import documents as D
from gridpulse.operators import vectors as V
from gridpulse.plans.evaluation import release_report, score_traces


def test_word_chunks_edges(spark):
    rows = [(0, ""), (1, " a  b \n c "), (2, " ".join(str(i) for i in range(10))), (3, " ".join(str(i) for i in range(13)))]
    out = D.chunk_documents(spark.createDataFrame(rows, "d int, t string"), "d", "t", 5, 1).orderBy("d", "chunk_no").collect()
    got = {}
    for r in out:
        got.setdefault(r["d"], []).append(r["chunk_text"])
    assert 0 not in got and got[1] == ["a b c"]
    for d, n in ((2, 10), (3, 13)):
        words = [str(i) for i in range(n)]
        want = []
        for start in range(0, n, 4):
            want.append(" ".join(words[start : start + 5]))
            if start + 5 >= n:
                break
        assert got[d] == want


def test_tokens_drop_accents_short_and_stop_words(spark):
    row = spark.createDataFrame([("¿Qué RÁFAGAS del vano-12 según él x_y?",)], "t string").select(tokens("t").alias("t"), plain_text("t").alias("p")).first()
    assert row["p"] == "que rafagas del vano-12 segun el x_y" and row["t"] == ["rafagas", "vano-12", "segun", "x_y"]


def corpus(spark):
    return spark.createDataFrame(
        [
            ("retie-1", "RETIE", ["retie"], "Condiciones de viento y distancias de seguridad"),
            ("manual-1", "Manual", ["manual"], "Mantenimiento de transformadores"),
            ("aislador-1", "Guia", ["aislador"], "Inspeccion de equipos"),
        ],
        "chunk_id string, title string, tags array<string>, text string",
    )


def test_lexical_search_and_boost(spark):
    ask = spark.createDataFrame([("q", "condiciones de viento")], "qid string, question string")
    plain = D.lexical_scores(corpus(spark), ask, "chunk_id", "qid", "text", "question", F.col("title"), F.col("tags"))
    assert [tuple(r) for r in D.top_k(plain, "qid", "chunk_id", 3).select("chunk_id", "score").collect()] == [("retie-1", 2.0)]
    vague = spark.createDataFrame([("q", "inspeccion"), ("none", "")], "qid string, question string")
    boosted = D.lexical_top_k(corpus(spark), vague, "chunk_id", "qid", "text", "question", 1, F.col("title"), F.col("tags"), boost=["aislador"])
    got = {r["qid"]: (r["chunk_id"], r["score"]) for r in boosted.collect()}
    assert got == {"q": ("aislador-1", pytest.approx(3.0)), "none": ("aislador-1", pytest.approx(2.0))}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_lexical_top_k_equals_whole_score_lists(spark, k):
    """Random chunks and questions, with boosted tags, ties, empty texts and null fields, in several tasks."""
    rng = np.random.default_rng(k)
    words = [f"word{i}" for i in range(40)]

    def pick(n):
        return " ".join(rng.choice(words, n)) if n else None

    rows = [(i, pick(int(rng.integers(0, 12))), pick(int(rng.integers(0, 3))), [f"tag{rng.integers(0, 4)}", str(rng.choice(words))] if i % 3 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "c long, t string, ti string, tg array<string>").repartition(4)
    asked = [(i, pick(int(rng.integers(0, 5)))) for i in range(25)]
    questions = spark.createDataFrame(asked, "q int, w string")
    boost = ["tag1", "tag2"]
    got = D.lexical_top_k(frame, questions, "c", "q", "t", "w", k, F.col("ti"), F.col("tg"), boost=boost).orderBy("q", "rank").collect()
    want = []
    split = lambda x: set((x or "").split())
    for q, w in asked:
        scored = []
        for c, t, ti, tg in rows:
            if not split(t):
                continue
            tags = set(tg or [])
            score = len(split(w) & split(t)) + 1.7 * len(split(w) & split(ti)) + 1.3 * len(split(w) & tags) + 2.0 * len(set(boost) & tags)
            if score > 0:
                scored.append((-round(score, 9), c))
        want += [(q, c, -s, i + 1) for i, (s, c) in enumerate(sorted(scored)[:k])]
    assert [(r["q"], r["c"], pytest.approx(r["score"]), r["rank"]) for r in got] == want


def test_context_words_count_as_question_words(spark):
    ask = spark.createDataFrame([("q", None, "condiciones de viento")], "qid string, question string, around string")
    best = D.lexical_top_k(corpus(spark), ask, "chunk_id", "qid", "text", "question", 2, context=F.col("around"))
    assert [r["chunk_id"] for r in best.collect()] == ["retie-1"]


def test_accents_of_all_latin_letters(spark):
    row = spark.createDataFrame([("Šárka Łódź ő ż Ǻ ệ Đ",)], "t string").select(plain_text("t").alias("p")).first()
    assert row["p"] == "sarka lodz o z a e d"


def test_title_and_tag_weights(spark):
    ask = spark.createDataFrame([("q", "retie")], "qid string, question string")
    row = D.lexical_scores(corpus(spark), ask, "chunk_id", "qid", "text", "question", F.col("title"), F.col("tags")).first()
    assert row["score"] == pytest.approx(1.7 + 1.3)


def test_cosine_top_k_matches_numpy(spark):
    rng = np.random.default_rng(1)
    items, asks = rng.normal(size=(200, 8)), rng.normal(size=(7, 8))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "i long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asks)], "q long, w array<double>")
    got = {}
    for r in V.cosine_top_k(frame, queries, "i", "q", "v", "w", 4, batch=3).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["i"])
    scores = (asks / np.linalg.norm(asks, axis=1, keepdims=True)) @ (items / np.linalg.norm(items, axis=1, keepdims=True)).T
    assert got == {q: list(np.argsort(-scores[q])[:4]) for q in range(7)}


def clustered(n, centres, seed=2, dimension=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    return middle[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dimension))


def vectors(spark, rows, names="i long, v array<double>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], names)


def test_index_recall_at_ten(spark):
    """Usual probes against the exact search, on clustered vectors and on vectors without any cluster."""
    for data in (clustered(3_000, 40), np.random.default_rng(3).normal(size=(3_000, 16))):
        items = vectors(spark, data).repartition(4)
        queries = vectors(spark, data[::20] + 0.05, "q long, w array<double>")
        exact = V.cosine_top_k(items, queries, "i", "q", "v", "w", 10)
        found = V.search_index(V.build_index(items, "i", "v"), queries, "q", "w", 10)
        recall = V.recall_per_query(found, exact, "q", "i").agg(F.avg("recall")).first()[0]
        print(f"recall at 10: {recall:.3f}")
        assert recall >= 0.9


def test_all_lists_and_small_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_VALUES", 256 * 16)
    data = np.vstack([clustered(1_500, 3), np.ones((400, 16))])
    items, queries = vectors(spark, data).repartition(3), vectors(spark, data[:700:2], "q long, w array<double>")
    index = V.build_index(items, "i", "v", lists=4)
    exact = V.cosine_top_k(items, queries, "i", "q", "v", "w", 5).orderBy("q", "rank").collect()
    assert V.search_index(index, queries, "q", "w", 5, probes=4).orderBy("q", "rank").collect() == exact


def test_stored_index_reads_only_probed_lists(spark, tmp_path):
    index = V.build_index(vectors(spark, clustered(400, 8)), "i", "v", lists=8)
    index.write(str(tmp_path))
    back = V.read_index(spark, str(tmp_path), "i", "v")
    assert np.allclose(back.centres, index.centres) and back.items.count() == 400
    plan = back.items.where("list = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan


def test_null_ragged_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [0.0, 2.0]), (8, [1.0, 0.0, 3.0])]
    items = spark.createDataFrame(rows, "i long, v array<double>")
    queries = spark.createDataFrame([(10, [2.0, 0.0]), (11, None), (12, [1.0]), (13, [0.0, 0.0])], "q long, w array<double>")
    want = [(10, 1, 1.0), (10, 4, 0.0), (10, 7, 0.0), (13, 1, 0.0), (13, 4, 0.0), (13, 7, 0.0)]
    exact = V.cosine_top_k(items, queries, "i", "q", "v", "w", 5).orderBy("q", "rank").select("q", "i", "score")
    assert [tuple(r) for r in exact.collect()] == want
    index = V.build_index(items, "i", "v", lists=2)
    found = V.search_index(index, queries, "q", "w", 5, probes=2).orderBy("q", "rank").select("q", "i", "score")
    assert [tuple(r) for r in found.collect()] == want
    none = items.where("v is null")
    assert V.cosine_top_k(none, queries, "i", "q", "v", "w", 5).count() == 0
    assert V.search_index(V.build_index(none, "i", "v"), queries, "q", "w", 5).count() == 0


def test_distinct_terms(spark):
    frame = spark.createDataFrame([(["UITI", " uiti", "Viento", None, "VIENTO ", "x"],)], "t array<string>")
    assert D.with_distinct_terms(frame, F.col("t"), limit=3).first()["query_text"] == "UITI Viento x"


def test_citation_check(spark):
    text = "# Norma [9]\nLa norma CREG exige. La norma aplica [1].\nVer [5] y [cita]. El documento dice algo."
    row = D.check_citations(spark.createDataFrame([(text, 2)], "a string, n int"), "a", "n").first()
    assert row["used_citations"] == [1, 5, 9] and row["unknown_citations"] == [5, 9] and row["placeholders"] == ["[cita]"]
    assert row["uncited_normative"] == ["La norma CREG exige."] and row["uncited_documentary"] == ["El documento dice algo."] and not row["valid"]


def test_uncited_claims_stop_at_five(spark):
    row = D.check_citations(spark.createDataFrame([("Norma. " * 9, 0)], "a string, n int"), "a", "n").first()
    assert len(row["uncited_normative"]) == 5


def test_claim_classes(spark):
    texts = ["El equipo no cumple", "Según CREG 015", "la causa fue el viento", "hola", "la mascara prueba el modelo"]
    rows = D.classify_claims(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [r["claim_type"] for r in rows] == [
        "definitive_legal_conclusion", "normative_claim", "definitive_causality", "general_interpretation", "model_claim",
    ]
    assert [r["forbidden_claim"] for r in rows] == [True, False, True, False, True]


def test_wording(spark):
    rows = D.check_wording(spark.createDataFrame([("El tramo NO cumple",), ("Sí cumple, posible riesgo",), ("Sanción aplicable",)], "t string"), "t").collect()
    assert [r["flagged"] for r in rows] == [["no cumple"], ["cumple"], ["sanción aplicable"]] and rows[1]["allowed_present"] == ["posible riesgo"]


def test_answer_sections(spark):
    text = "## Estado observado\nLinea uno\nsigue\n\n- punto **a**\n- punto b\n**Recomendaciones:** revisar\n1. otra\nFuentes usadas:"
    rows = D.answer_sections(spark.createDataFrame([(1, text), (2, "sin titulos\naqui"), (3, "")], "i int, t string"), "i", "t").collect()
    got = {(r["i"], r["section"]): (r["items"], r["missing"]) for r in rows}
    assert got[(1, "estado_observado")] == (["Linea uno sigue", "punto **a**", "punto b"], False)
    assert got[(1, "recomendaciones")] == (["revisar", "otra"], False)
    assert got[(1, "citas_usadas")][1] and got[(2, "estado_observado")] == (["sin titulos aqui"], False)
    assert len(rows) == 27 and got[(3, "estado_observado")][1]


def test_routing(spark):
    rows = D.route_tools(spark.createDataFrame([("¿Qué norma aplica al evento?",), ("condiciones del viento",), ("hola",)], "t string"), "t").collect()
    assert rows[0]["tools"] == ["get_compliance_context", "get_event_context", "search_regulatory_documents"]
    assert rows[1]["tools"] == ["search_technical_documents"] and rows[2]["tools"] == []


def test_mask_rows(spark):
    frame = spark.createDataFrame(
        [(1, '[0.5, {"feature":"viento","score":0.2,"mode":"clima"}, "x"]'), (2, '{"a": 1.5, "b": {"importance": -2}, "c": null}')], "i int, p string"
    )
    got = {(r["i"], r["feature_name"], r["relevance_score"], r["mode"]) for r in D.mask_rows(frame, "i", "p").collect()}
    assert got == {(1, "feature_0", 0.5, "model_signal"), (1, "viento", 0.2, "clima"), (2, "a", 1.5, "model_signal"), (2, "b", -2.0, "model_signal")}


def test_memory_of_one_turn(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", f"tema {i}") for i in range(6)]
    out = D.bounded_memory(spark.createDataFrame(rows, "c string, t int, r string, x string"), "c", "t", "r", "x", 1).collect()
    assert len(out) == 3
    digest = [r for r in out if r["turn_id"].startswith("memory-")][0]
    assert "4 mensajes previos omitidos (2 usuario, 2 asistente). Primer tema: tema 0." in digest["content"] and "tema 3." in digest["content"]


def test_memory_counts_equal_messages(spark):
    rows = [("c", 1, "user", "hola")] * 3 + [("c", 2, "assistant", "si")]
    out = D.bounded_memory(spark.createDataFrame(rows, "c string, t int, r string, x string"), "c", "t", "r", "x", 1).collect()
    digest = [r for r in out if r["turn_id"].startswith("memory-")][0]["content"]
    assert len(out) == 3 and "2 mensajes previos omitidos (2 usuario, 0 asistente). Primer tema: hola." in digest and "reciente: hola." in digest
    none = D.bounded_memory(spark.createDataFrame(rows[2:], "c string, t int, r string, x string"), "c", "t", "r", "x", 1).collect()
    assert len(none) == 2


def test_budget_counts_text_before(spark):
    ranked = spark.createDataFrame([("g", i, "x" * 40) for i in range(1, 8)], "g string, rank int, t string")
    assert [r["rank"] for r in D.within_budget(ranked, "g", "t", 100, 5).orderBy("rank").collect()] == [1, 2, 3]


def test_trace_scores_and_report(spark):
    frame = spark.createDataFrame(
        [(["a", "b", "c"], ["a", "b"], 9, True, True, 420, True)],
        "retrieved_chunk_ids array<string>, cited_ids array<string>, section_count int, citation_valid boolean, compliance_valid boolean, latency_ms int, ready boolean",
    )
    scores = score_traces(frame)
    row = release_report(scores).first()
    assert row["retrieval_precision_at_3"] == 0.6667 and row["latency_p95"] == 420.0 and row["release_status"] == "passed"


def test_slug_and_generated_id(spark):
    row = spark.createDataFrame([("Guía  Técnica_1", " ")], "n string, i string").select(slug("n").alias("s"), generated_id("i", "local-event", a="n").alias("g")).first()
    assert row["s"] == "guia-tecnica-1" and row["g"].startswith("local-event-") and len(row["g"]) == 28


@pytest.mark.parametrize("probes", [1, 300])
def test_probed_rows_come_in_bounded_batches(probes):
    """A row is repeated for each probed list, so a batch of rows must shrink as the lists grow in number."""
    numbers = np.random.default_rng(1)
    centres, rows = numbers.normal(size=(900, 64)), numbers.normal(size=(2_000, 64))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(2_000)), "v": pa.array(rows.tolist(), pa.list_(pa.float64()))})
    parts = list(V._assigned(batch, "v", centres, probes))
    assert all(p.num_rows * 64 <= V.CELL_VALUES for p in parts)
    assert np.array_equal(np.concatenate([p.column("id").to_numpy() for p in parts]), np.repeat(np.arange(2_000), probes))
    units = V._unit(rows) @ centres.T
    first = np.concatenate([p.column("list").to_numpy() for p in parts]).reshape(2_000, probes)
    assert np.array_equal(first, np.argsort(-units, axis=1, kind="stable")[:, :probes])


def told(frame, q="q", i="i"):
    return sorted((repr(r[q]), r["rank"], repr(r[i]), round(r["score"], 9)) for r in frame.collect())


def test_many_queries_read_the_items_once(spark):
    """Queries beyond a batch are dealt to tasks in blocks; there is no pass over the items for each batch of them."""
    data = clustered(400, 5)
    items, queries = vectors(spark, data).repartition(3), vectors(spark, data[::2], "q long, w array<double>")
    found = V.cosine_top_k(items, queries, "i", "q", "v", "w", 5, batch=4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert told(found) == told(V.cosine_top_k(items, queries, "i", "q", "v", "w", 5))


def test_probed_queries_are_stored_once(spark, monkeypatch):
    """A query carries its lists as bits: what is stored does not grow with the lists that it probes."""
    stored, store = [], V.RoundTables.store

    def spied(self, frame):
        out = store(self, frame)
        stored.append(out.count())
        return out

    monkeypatch.setattr(V.RoundTables, "store", spied)
    index = V.build_index(vectors(spark, clustered(600, 20)), "i", "v", lists=30)
    stored.clear()
    queries = vectors(spark, clustered(90, 20), "q long, w array<double>")
    assert V.search_index(index, queries, "q", "w", 3, probes=12).count() == 90 * 3
    assert sum(stored) <= 600 + 90


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_of_queries_equal_all_pairs(spark, monkeypatch, kind):
    """Ties, equal vectors, zero vectors, repeated and null ids of both sides, in many cells and steps."""
    monkeypatch.setattr(V, "CELL_VALUES", 256 * 8)
    monkeypatch.setattr(V, "FEW_PAIRS", 1)
    monkeypatch.setattr(V, "STREAM_VALUES", 300 * 8)
    monkeypatch.setattr(V, "ITEM_ROWS", 16)
    monkeypatch.setattr(V, "QUERY_ROWS", 32)
    rng = np.random.default_rng(6)
    data = np.vstack([rng.normal(size=(500, 8)), np.tile(rng.normal(size=8), (300, 1)), np.zeros((20, 8)), rng.integers(-1, 2, (180, 8))])
    data = np.vstack([data, data[480:520] * 3.0, data[:40] + 1e-8 * rng.normal(size=(40, 8))]).astype(np.float32)
    data = data[rng.permutation(len(data))]
    ids = [None if i % 97 == 0 else i // 2 if i % 5 == 0 else i for i in rng.permutation(len(data)).tolist()]
    ids = [x if x is None or kind == "long" else f"id{x}" for x in ids]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, data, strict=True)]
    items = spark.createDataFrame(rows, f"i {kind}, v array<float>").repartition(5)
    queries = spark.createDataFrame(rows[::2], f"q {kind}, w array<double>").repartition(3)
    first = lambda x: (x is not None, x)
    unit = data.astype(float) / np.maximum(np.linalg.norm(data.astype(float), axis=1, keepdims=True), 1e-300)
    scores, asked = np.round(unit[::2] @ unit.T, 9), {}
    for n, row in enumerate(scores):
        best = sorted(zip(-row, ids, strict=True), key=lambda x: (x[0], first(x[1])))[:6]
        asked[ids[2 * n]] = sorted([*asked.get(ids[2 * n], []), *best], key=lambda x: (x[0], first(x[1])))[:6]
    want = sorted((repr(q), rank, repr(i), round(-s, 9) + 0.0) for q, best in asked.items() for rank, (s, i) in enumerate(best, 1))
    assert told(V.cosine_top_k(items, queries, "i", "q", "v", "w", 6, batch=10)) == want
    index = V.build_index(items, "i", "v", lists=9)
    assert told(V.search_index(index, queries, "q", "w", 6, probes=9)) == want


def test_probed_lists_alone_are_searched(spark, monkeypatch):
    """With some of the lists, the best of their items alone are found, for each query by its nearest centres."""
    monkeypatch.setattr(V, "FEW_PAIRS", 1)
    data, asks = clustered(700, 12, dimension=8), clustered(60, 12, seed=5, dimension=8)
    index = V.build_index(vectors(spark, data).repartition(4), "i", "v", lists=11)
    units, ask = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (data, asks))
    of = (units @ index.centres.T).argmax(axis=1)
    want = []
    for q, near in enumerate(np.argsort(-(ask @ index.centres.T), axis=1)[:, :3]):
        score = np.where(np.isin(of, near), np.round(units @ ask[q], 9), -9)
        want += [(repr(q), r, repr(int(i)), round(score[i], 9)) for r, i in enumerate(np.argsort(-score, kind="stable")[:4], 1)]
    assert told(V.search_index(index, vectors(spark, asks, "q long, w array<double>"), "q", "w", 4, probes=3)) == sorted(want)
