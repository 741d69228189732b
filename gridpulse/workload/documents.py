"""Chunks, retrieval and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import documents as D
from gridpulse.operators import series as S
from gridpulse.operators import vectors as V
from gridpulse.plans import interpret
from gridpulse.workload.cleaning import sql_plain, sql_tokens
from gridpulse.workload.registry import query, stream_daily, text_day
from gridpulse.workload.series import RANKED

SQUEEZE = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
SIZE, OVERLAP = 200, 40
STEP = SIZE - OVERLAP
CHUNKS = f"""w AS (SELECT doc_id, lang, source, string_split({SQUEEZE}, ' ') AS words FROM documents WHERE length({SQUEEZE}) > 0),
c AS (SELECT doc_id, lang, source, words, unnest(range(CASE WHEN len(words) <= {SIZE} THEN 1 ELSE CAST(ceil((len(words) - {SIZE}) / {STEP}.0) AS BIGINT) + 1 END)) AS chunk_no FROM w),
chunks AS (SELECT doc_id, lang, source, chunk_no, array_to_string(words[chunk_no * {STEP} + 1 : chunk_no * {STEP} + {SIZE}], ' ') AS chunk_text FROM c)"""


def _chunks(t):
    return D.chunk_documents(t.spread("documents"), "doc_id", "text", SIZE, OVERLAP, keep=("lang", "source"))


@query("d01_word_chunks", f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, length(chunk_text) AS n_chars, md5(chunk_text) AS text_md5 FROM chunks")
def _(t):
    return _chunks(t).select("doc_id", "chunk_no", F.length("chunk_text").cast("long").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


@query(
    "d02_chunk_ids",
    f"WITH {CHUNKS}, i AS (SELECT *, 'doc-' || lang || '-' || source || '-' || left(sha1('/corpus/' || doc_id), 16) AS document_id FROM chunks) SELECT document_id, document_id || '-' || chunk_no AS chunk_id FROM i",
)
def _(t):
    rows = _chunks(t).withColumns({"title": F.concat_ws(" ", "lang", "source"), "path": F.concat(F.lit("/corpus/"), "doc_id")})
    return D.chunk_identity(rows, "title", "path").select("document_id", "chunk_id")


@query("d02_document_manifest", f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, min(source) AS title FROM chunks GROUP BY doc_id")
def _(t):
    return D.document_manifest(_chunks(t), "doc_id", "source")


def _silver(t):
    rows = t.spread("documents").select(
        F.concat(F.lit("c"), F.col("doc_id") % 500).alias("chunk_id"), "text", F.col("doc_id").alias("created_at"),
        F.when(F.col("doc_id") % 2 == 0, "PDF").when(F.col("doc_id") % 3 == 0, "xlsx").alias("source_type"),
        F.concat(F.lit("x/"), "source", F.lit(".pdf")).alias("source_path"),
    )
    return D.chunk_silver(rows, "/docs")


@query(
    "d03_current_chunks",
    "WITH s AS (SELECT 'c' || doc_id % 500 AS chunk_id, doc_id AS created_at, sha256(text) AS text_hash, CASE WHEN doc_id % 2 = 0 THEN 'PDF' WHEN doc_id % 3 = 0 THEN 'xlsx' END AS st, source FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0) "
    "SELECT chunk_id, created_at, text_hash, coalesce(st, 'technical_document') AS document_type, '/docs/' || source || '.pdf' AS source_uri, CASE lower(coalesce(st, '')) WHEN 'pdf' THEN 'normative_or_technical_document' WHEN 'xlsx' THEN 'metadata_workbook' ELSE 'technical_document' END AS authority_level "
    "FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, text_hash DESC) = 1",
)
def _(t):
    return D.current_chunks(_silver(t)).select("chunk_id", "created_at", "text_hash", "document_type", "source_uri", "authority_level")


SCORES = f"""dt AS (SELECT doc_id, length(trim(text)) AS n_chars, {sql_tokens('text')} AS tx, {sql_tokens("lang || ' ' || source")} AS ti FROM documents),
qt AS (SELECT item_id, {sql_tokens('text')} AS q FROM benchmark),
sc AS (SELECT item_id, doc_id, n_chars, round(len(list_intersect(q, tx)) + 1.7::DOUBLE * len(list_intersect(q, ti)), 4) AS score FROM qt, dt WHERE len(tx) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


def _best(t, k):
    best = D.lexical_top_k(t.spread("documents"), t.benchmark, "doc_id", "item_id", "text", "text", k, title=F.concat_ws(" ", "lang", "source"))
    return best.withColumn("score", F.round("score", 4))


@query("d04_lexical_top_k", f"WITH {SCORES} SELECT item_id, doc_id, score, rank FROM rk WHERE rank <= 10")
def _(t):
    return _best(t, 10)


@query(
    "d04_boosted_top_k",
    f"WITH {SCORES}, tg AS (SELECT doc_id, {sql_tokens('source')} AS tg FROM documents), "
    "bo AS (SELECT item_id, dt.doc_id, round(len(list_intersect(q, tx)) + 1.3::DOUBLE * len(list_intersect(q, tg)) + 2.0::DOUBLE * len(list_intersect(['src1', 'src3'], tg)), 4) AS score "
    "FROM qt, dt JOIN tg ON tg.doc_id = dt.doc_id WHERE len(tx) > 0) "
    "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bo WHERE score > 0 QUALIFY rank <= 7",
)
def _(t):
    best = D.lexical_top_k(
        t.spread("documents"), t.benchmark, "doc_id", "item_id", "text", "text", 7, tags=F.array("source"), boost=["src1", "src3"]
    )
    return best.withColumn("score", F.round("score", 4))


@query(
    "d04_all_scores",
    f"WITH {SCORES} SELECT doc_id, count(*) AS questions, round(sum(score), 4) AS score FROM rk GROUP BY doc_id",
)
def _(t):
    scores = D.lexical_scores(t.spread("documents"), t.benchmark, "doc_id", "item_id", "text", "text", title=F.concat_ws(" ", "lang", "source"))
    return scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.sum(F.round("score", 4)), 4).alias("score"))


@query(
    "d05_within_budget",
    f"WITH {SCORES}, sn AS (SELECT *, least(n_chars, 900) AS sl FROM rk WHERE rank <= 15 AND n_chars > 0), u AS (SELECT *, coalesce(sum(sl) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM sn) "
    "SELECT item_id, doc_id, rank, CAST(sl AS BIGINT) AS snippet_chars FROM u WHERE used < 2500 AND place <= 5",
)
def _(t):
    ranked = _best(t, 15).join(t.documents.select("doc_id", "text"), "doc_id")
    return D.within_budget(ranked, "item_id", "text", 2500, 5).select("item_id", "doc_id", "rank", F.length("snippet").cast("long").alias("snippet_chars"))


@query(
    "w15_running_budget",
    "WITH r AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE length(trim(text)) > 0) "
    "SELECT conv_id, turn FROM r WHERE coalesce(used, 0) < 600 AND k <= 4",
)
def _(t):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    ranked = t.conversations.where("length(trim(text)) > 0").withColumn("rank", F.row_number().over(order))
    return D.within_budget(ranked, "conv_id", "text", 600, 4, chars=10_000_000).select("conv_id", "turn")


CENTRES = "ctr AS (SELECT label AS query_id, " + ", ".join(f"avg(embedding[{i}]::DOUBLE) AS d{i}" for i in range(1, 65)) + " FROM embeddings GROUP BY label)"
EXACT = (
    f"WITH {CENTRES}, cv AS (SELECT query_id, [{', '.join(f'd{i}' for i in range(1, 65))}] AS q FROM ctr), s AS (SELECT query_id, vec_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS score FROM cv, embeddings) "
    "SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 10"
)


def _label_means(t):
    means = t.embeddings.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(64)])
    return means.select(F.col("label").alias("query_id"), F.array(*[f"d{i}" for i in range(64)]).alias("q"))


@query("d06_cosine_top_k", EXACT)
def _(t):
    out = V.cosine_top_k(t.embeddings, _label_means(t), "vec_id", "query_id", "embedding", "q", 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("d06_indexed_all_lists", EXACT)
def _(t):
    """The index with every list probed, which is exact."""
    index = V.build_index(t.embeddings, "vec_id", "embedding")
    out = V.search_index(index, _label_means(t), "query_id", "q", 10, probes=len(index.centres))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("d06_index_recall")
def _(t):
    """Share of the exact ten neighbours that the index finds by its usual probes, every embedding being a query."""
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = V.cosine_top_k(t.embeddings, queries, "vec_id", "query_id", "embedding", "q", 10)
    found = V.search_index(V.build_index(t.embeddings, "vec_id", "embedding"), queries, "query_id", "q", 10)
    return V.recall_per_query(found, exact, "query_id", "vec_id")


@query(
    "d06_fused_scores",
    f"WITH {SCORES}, cs AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score "
    "FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings e), "
    "vs AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50), "
    "a AS (SELECT item_id, doc_id, score / max(score) OVER (PARTITION BY item_id) AS a FROM rk WHERE rank <= 50), "
    "b AS (SELECT item_id, doc_id, score / max(score) OVER (PARTITION BY item_id) AS b FROM vs), "
    "f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, 0.5::DOUBLE * coalesce(a, 0) + 0.5::DOUBLE * coalesce(b, 0) AS score "
    "FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id) "
    "SELECT item_id, doc_id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 5",
)
def _(t):
    """Words and vectors: an item's vector is the embedding of its number, a document's likewise."""
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    near = V.cosine_top_k(t.embeddings, asked, "vec_id", "item_id", "embedding", "q", 50).withColumnRenamed("vec_id", "doc_id")
    fused = D.fused_scores(_best(t, 50), near, ["item_id", "doc_id"]).withColumn("score", F.round("score", 9))
    return D.top_k(fused, "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "d07_query_terms",
    "WITH b AS (SELECT conv_id, turn, list_concat(['UITI', 'impacto'], list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: length(x) > 0)) AS ts FROM conversations), "
    "f AS (SELECT conv_id, turn, list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i)[1:40] AS k FROM b) SELECT conv_id, turn, array_to_string(k, ' ') AS query_text FROM f",
)
def _(t):
    terms = F.concat(F.array(F.lit("UITI"), F.lit("impacto")), F.split("text", " "))
    return D.with_distinct_terms(t.spread("conversations"), terms).select("conv_id", "turn", "query_text")


@query(
    "d08_citation_rows",
    f"WITH {SCORES} SELECT item_id, CAST(rank AS INTEGER) AS citation_no, 'd' || rk.doc_id AS id, source AS title, md5(left(text, 900)) AS snippet_md5, score FROM rk JOIN documents d ON d.doc_id = rk.doc_id WHERE rank <= 3",
)
def _(t):
    top = _best(t, 3).join(t.documents.select("doc_id", "source", "text"), "doc_id")
    item = F.struct("rank", F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("title"), "text", "score")
    lists = top.groupBy("item_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    return D.citation_rows(lists, "item_id", "chunks").select("item_id", "citation_no", "id", "title", F.md5("snippet").alias("snippet_md5"), "score")


ANSWERS = """an AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' Según la norma RETIE aplica.' WHEN 1 THEN ' El documento lo indica [2]. Falta [x].' WHEN 2 THEN ' Ver [1] y [7].' ELSE ' La bitácora registra mantenimiento [3].' END AS answer FROM conversations)"""


def _answers(t):
    turn = F.col("turn") % 4
    tail = (
        F.when(turn == 0, " Según la norma RETIE aplica.").when(turn == 1, " El documento lo indica [2]. Falta [x].")
        .when(turn == 2, " Ver [1] y [7].").otherwise(" La bitácora registra mantenimiento [3].")
    )
    return t.spread("conversations").select("conv_id", "turn", F.concat("text", tail).alias("answer"), F.lit(3).alias("available"))


@query(
    "d09_citation_check",
    f"WITH {ANSWERS}, u AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,3}})\\]', 1), lambda x: CAST(x AS INTEGER)))) AS used, "
    "list_distinct(regexp_extract_all(answer, '(?i)(\\[(?:x|xx|citation|cita|pendiente)\\])', 1)) AS ph FROM an) "
    "SELECT conv_id, turn, array_to_string(used, ',') AS used, array_to_string(list_filter(used, lambda n: n < 1 OR n > 3), ',') AS unknown, array_to_string(ph, ',') AS placeholders FROM u",
)
def _(t):
    out = D.check_citations(_answers(t), "answer", "available")
    return out.select(
        "conv_id", "turn", F.array_join(F.transform("used_citations", lambda x: x.cast("string")), ",").alias("used"),
        F.array_join(F.transform("unknown_citations", lambda x: x.cast("string")), ",").alias("unknown"), F.array_join("placeholders", ",").alias("placeholders"),
    )


def _uncited_sql(terms) -> str:
    test = " OR ".join(f"contains({sql_plain('s')}, '{w}')" for w in terms)
    return f"array_to_string(list_transform(list_filter(ss, lambda s: ({test}) AND NOT regexp_matches(s, '\\[\\d{{1,3}}\\]'))[1:5], lambda s: left(s, 260)), ' | ')"


# sentences by marking each break after a full stop, question or exclamation mark
_SENTENCES = (
    "ln AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: length(l) > 0 AND NOT starts_with(l, '#')) AS ls FROM an), "
    "sn AS (SELECT conv_id, turn, list_filter(flatten(list_transform(ls, lambda l: string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda s: length(trim(s)) > 0) AS ss FROM ln)"
)


@query(
    "d09_uncited_claims",
    f"WITH {ANSWERS}, {_SENTENCES} SELECT conv_id, turn, {_uncited_sql(D.NORMATIVE_TERMS)} AS uncited_normative, {_uncited_sql(D.DOCUMENTARY_TERMS)} AS uncited_documentary FROM sn",
)
def _(t):
    out = D.check_citations(_answers(t), "answer", "available")
    return out.select(
        "conv_id", "turn", F.array_join("uncited_normative", " | ").alias("uncited_normative"),
        F.array_join("uncited_documentary", " | ").alias("uncited_documentary"),
    )


@query("d09_citation_errors")
def _(t):
    out = D.check_citations(_answers(t), "answer", "available")
    return out.select("conv_id", "turn", F.array_join("errors", ",").alias("errors"), F.col("valid").cast("int").alias("valid"))


def _claim_case() -> str:
    arms = []
    for name, words, pattern in D.CLAIM_CLASSES:
        if pattern:
            arms.append(f"WHEN regexp_matches(answer, '{pattern}') THEN '{name}'")
        else:
            arms.append("WHEN " + " OR ".join(f"contains(pl, '{w}')" for w in words) + f" THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE 'general_interpretation' END"


CLAIMS = """an AS (SELECT doc_id, text || CASE doc_id % 8 WHEN 0 THEN ' La causa fue el viento.' WHEN 1 THEN ' El equipo no cumple.' WHEN 2 THEN ' Norma CREG.' WHEN 3 THEN ' Según la bitácora.' WHEN 4 THEN ' La predicción sube.' WHEN 5 THEN ' Falta inspección.'
 WHEN 6 THEN ' Duración y usuarios.' ELSE '' END AS answer FROM documents)"""


def _claims(t):
    tails = [" La causa fue el viento.", " El equipo no cumple.", " Norma CREG.", " Según la bitácora.", " La predicción sube.", " Falta inspección.", " Duración y usuarios.", ""]
    tail = None
    for i, text in enumerate(tails):
        test = F.col("doc_id") % 8 == i
        tail = F.when(test, text) if tail is None else tail.when(test, text)
    return t.spread("documents").select("doc_id", F.concat("text", tail).alias("answer"))


@query(
    "d10_claim_class",
    f"WITH {CLAIMS}, p AS (SELECT *, {sql_plain('answer')} AS pl FROM an) SELECT doc_id, {_claim_case()} AS claim_type, CASE WHEN "
    + " OR ".join(f"regexp_matches(answer, '{p}')" for p in D.FORBIDDEN_PATTERNS) + " THEN 1 ELSE 0 END AS forbidden FROM p",
)
def _(t):
    return D.classify_claims(_claims(t), "answer").select("doc_id", "claim_type", F.col("forbidden_claim").cast("int").alias("forbidden"))


@query(
    "d11_wording",
    f"WITH {CLAIMS}, n AS (SELECT doc_id, {sql_plain('answer')} AS pl FROM an) SELECT doc_id, CASE WHEN regexp_matches(pl, '\\bno cumple\\b') THEN 'no cumple' ELSE '' END AS flagged FROM n",
)
def _(t):
    return D.check_wording(_claims(t), "answer").select("doc_id", F.array_join("flagged", ",").alias("flagged"))


SECTIONED = """an AS (SELECT conv_id * 100 + turn AS id, '## Estado observado:' || chr(10) || replace(text, chr(10), ' ') || chr(10) || chr(10) || '**Recomendaciones**: revisar ' || turn || chr(10) || '- uno' || chr(10) || '2) dos' || chr(10) || 'Fuentes usadas' AS answer FROM conversations)"""


def _sectioned(t):
    answer = F.concat(
        F.lit("## Estado observado:\n"), F.regexp_replace("text", "\n", " "), F.lit("\n\n**Recomendaciones**: revisar "), F.col("turn"), F.lit("\n- uno\n2) dos\nFuentes usadas")
    )
    return t.spread("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), answer.alias("answer"))


@query(
    "d12_answer_sections",
    f"WITH {SECTIONED}, k AS (SELECT id, {SQUEEZE.replace('text', 'text0')} AS body, turn FROM (SELECT conv_id * 100 + turn AS id, turn, text AS text0 FROM conversations)), "
    "s(section, ord) AS (VALUES ('estado_observado', 1), ('banderas_evidencia', 2), ('requisitos_posiblemente_aplicables', 3), ('datos_faltantes', 4), ('riesgo_posible', 5), ('recomendaciones', 6), ('limitaciones', 7), ('citas_usadas', 8), ('preguntas_sugeridas', 9)) "
    "SELECT id, section, CASE section WHEN 'estado_observado' THEN CASE WHEN length(body) = 0 THEN 1 ELSE 1 END WHEN 'recomendaciones' THEN 3 ELSE 1 END AS n_items, CASE WHEN section = 'recomendaciones' OR (section = 'estado_observado' AND length(body) > 0) THEN 0 ELSE 1 END AS missing FROM k, s",
)
def _(t):
    out = D.answer_sections(_sectioned(t), "id", "answer")
    return out.select("id", "section", F.size("items").alias("n_items"), F.col("missing").cast("int").alias("missing"))


def _route_case() -> str:
    arms = []
    for tool, terms in D.ROUTES.items():
        test = f"len(list_intersect(w, [{', '.join(repr(x) for x in terms)}])) > 0"
        if tool == D.EXCLUSIVE[1]:
            first = D.ROUTES[D.EXCLUSIVE[0]]
            test += f" AND len(list_intersect(w, [{', '.join(repr(x) for x in first)}])) = 0"
        arms.append(f"CASE WHEN {test} THEN '{tool}' END")
    return "array_to_string(list_filter([" + ", ".join(arms) + "], lambda x: x IS NOT NULL), ',')"


@query("d13_route_tools", f"WITH {CLAIMS}, p AS (SELECT doc_id, string_split({sql_plain('answer')}, ' ') AS w FROM an) SELECT doc_id, {_route_case()} AS tools FROM p")
def _(t):
    return D.route_tools(_claims(t), "answer").select("doc_id", F.array_join("tools", ",").alias("tools"))


@query(
    "d14_mask_rows",
    "SELECT event_id, 'k' AS feature_name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS relevance_score, 'map' AS form FROM events UNION ALL "
    "SELECT event_id, 'feature_0', value, 'list' FROM events UNION ALL SELECT event_id, event_type, CAST(user_id AS DOUBLE), 'list' FROM events",
)
def _(t):
    maps = t.events.select("event_id", F.col("props").alias("payload"))
    item = F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("score"))
    lists = t.events.select("event_id", F.concat(F.lit("["), F.col("value"), F.lit(","), F.to_json(item), F.lit(",\"n/a\"]")).alias("payload"))
    one = D.mask_rows(maps, "event_id", "payload").withColumn("form", F.lit("map"))
    two = D.mask_rows(lists, "event_id", "payload").withColumn("form", F.lit("list"))
    return one.unionByName(two).select("event_id", "feature_name", "relevance_score", "form")


@query(
    "d15_grounding_errors",
    f"WITH {RANKED}, n AS (SELECT circuit, day, CASE WHEN date_diff('day', DATE '2024-01-01', day) % 3 = 0 THEN 1 ELSE 2 END AS rank, [1, 4] AS cites, 'historial de 12 meses' AS txt FROM series), "
    "j AS (SELECT n.*, p.rank AS pr FROM n LEFT JOIN points p USING (circuit, day)) "
    "SELECT circuit AS series, CAST(day AS VARCHAR) AS day, 'point_narrative_date_not_grounded:' || day AS error FROM j WHERE pr IS NULL UNION ALL SELECT circuit, CAST(day AS VARCHAR), 'point_rank_mismatch:' || day FROM j WHERE pr <> rank "
    "UNION ALL SELECT circuit, CAST(day AS VARCHAR), 'invalid_citation:4' FROM j UNION ALL SELECT circuit, CAST(day AS VARCHAR), 'forbidden_phrase:12 meses' FROM j",
)
def _(t):
    filled = S.zero_filled_daily(stream_daily(t), ["circuit"])
    points = interpret.critical_points(filled, ["circuit"]).withColumnRenamed("circuit", "series")
    told = filled.select(
        F.col("circuit").alias("series"), "day", F.when(F.datediff("day", F.lit("2024-01-01")) % 3 == 0, 1).otherwise(2).alias("rank"),
        F.array(F.lit(1), F.lit(4)).alias("citations"), F.lit(3).alias("n_citations"), F.lit("historial de 12 meses").alias("text"),
    )
    return D.grounding_errors(told, points, ["12 meses", "no cumple"]).select("series", text_day(), "error")
