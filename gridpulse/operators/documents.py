"""Chunking, lexical and vector retrieval, and checks over answer texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridpulse.functions.cleaning import as_column
from gridpulse.functions.text import plain_text, slug, tokens
from gridpulse.operators.joins import latest_by_key
from gridpulse.operators.vectors import cosine_top_k as cosine_top_k
from gridpulse.scale import collect_passes

# Chunk length and overlap in words, snippet length, scoring weights.
CHUNK_WORDS, OVERLAP_WORDS, SNIPPET_CHARS = 700, 90, 900
TITLE_WEIGHT, TAG_WEIGHT, BOOST_WEIGHT = 1.7, 1.3, 2.0


def squeeze(value: Column | str) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(value), F.lit("")), "\\s+", " "))


def chunk_documents(
    documents: DataFrame, doc_id: str, text: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, keep: Sequence[str] = ()
) -> DataFrame:
    """(document, chunk number from 0, chunk text): word windows over the whole text, the last one being the
    first to reach the end. No shuffle; the words of a text are split once and only chunk texts are exploded."""
    step = max(size - overlap, 1)
    words = documents.select(doc_id, *keep, F.split(squeeze(text), " ").alias("_words"))
    count = F.size("_words")
    last = F.when(count <= size, F.lit(0)).otherwise(F.ceil((count - size) / step).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_words", i * step + 1, size), " "))
    return (
        words.where(F.get("_words", F.lit(0)) != "")
        .select(doc_id, *keep, F.posexplode(parts).alias("chunk_no", "chunk_text"))
    )


def chunk_identity(chunks: DataFrame, title: str, path: str, prefix: str = "doc") -> DataFrame:
    """Document id from title slug and path hash, chunk id below it, tags from title slugs."""
    name = slug(title)
    document = F.concat_ws("-", F.lit(prefix), name, F.substring(F.sha1(F.col(path)), 1, 16))
    return chunks.withColumns(
        {
            "document_id": document,
            "chunk_id": F.concat_ws("-", document, F.col("chunk_no").cast("string")),
            "tags": F.array_distinct(F.filter(F.array(name, slug(path)), lambda t: F.length(t) > 0)),
        }
    )


def document_manifest(chunks: DataFrame, document: str = "document_id", title: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("chunks")]
    if title:
        aggs.append(F.min(title).alias("title"))
    return chunks.groupBy(document).agg(*aggs)


def chunk_silver(chunks: DataFrame, documents_root: str) -> DataFrame:
    """Typed chunk rows with source address, authority level and text hash; blank rows are left out."""
    path = F.col("source_path").cast("string")
    kind = F.lower(F.coalesce(F.col("source_type").cast("string"), F.lit("")))
    return (
        chunks.where("text is not null and chunk_id is not null and length(trim(text)) > 0")
        .withColumns(
            {
                "document_type": F.coalesce(F.col("source_type").cast("string"), F.lit("technical_document")),
                "source_uri": source_uri(path, documents_root),
                "authority_level": authority_level(kind),
                "text_hash": F.sha2("text", 256),
            }
        )
    )


def source_uri(path: Column, root: str, marker: str = "arbol_decision_recomendaciones/") -> Column:
    """Volume paths stay, ``dbfs:`` is cut off, marked paths and plain names move under ``root``."""
    return (
        F.when(path.startswith("/Volumes/"), path)
        .when(path.startswith("dbfs:/"), F.regexp_replace(path, "^dbfs:", ""))
        .when(path.contains(marker), F.concat(F.lit(f"{root}/"), F.regexp_extract(path, f"{marker}(.*)$", 1)))
        .otherwise(F.concat(F.lit(f"{root}/"), F.regexp_extract(path, "[^/]+$", 0)))
    )


def authority_level(kind: Column) -> Column:
    return (
        F.when(kind == "pdf", "normative_or_technical_document")
        .when(kind == "xlsx", "metadata_workbook")
        .otherwise("technical_document")
    )


def current_chunks(silver: DataFrame, created: str = "created_at") -> DataFrame:
    """Latest row per chunk id."""
    return latest_by_key(silver, ["chunk_id"], [F.desc(created), F.desc("text_hash")])


def lexical_scores(
    chunks: DataFrame,
    questions: DataFrame,
    chunk_id: str,
    question_id: str,
    text: str,
    question: str,
    title: Column | None = None,
    tags: Column | None = None,
) -> DataFrame:
    """(question, chunk, score) for every pair sharing a token, weighted by text, title and tags.

    For whole score lists; :func:`lexical_top_k` keeps the best of each question as it reads.

    The questions' tokens are the small side: chunk tokens look them up and hits are summed per
    (question, chunk) in the task that read the chunk, so a frequent token never gathers in one task.
    """
    fields = {"_text": (tokens(text), 1.0)}
    if title is not None:
        fields["_title"] = (tokens(title), TITLE_WEIGHT)
    if tags is not None:
        fields["_tags"] = (tokens(F.array_join(tags, " ")), TAG_WEIGHT)
    # token sets are made once per chunk, then weighed
    usable = chunks.select(chunk_id, *[words.alias(name) for name, (words, _) in fields.items()])

    def weigh(name: str, weight: float) -> Column:
        return F.transform(name, lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight")))

    weighted = F.concat(*[weigh(name, weight) for name, (_, weight) in fields.items()])
    # a chunk without text tokens is left out; tested here so that the tokens are not made a second time
    hits = usable.select(chunk_id, F.explode(F.when(F.size("_text") > 0, weighted)).alias("_t")).select(chunk_id, "_t.*")
    asked = questions.select(F.col(question_id), F.explode(tokens(question)).alias("token"))
    scored = hits.join(asked, "token").groupBy(question_id, chunk_id).agg(F.sum("weight").alias("score"))
    return scored.where("score > 0")


def lexical_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    chunk_id: str,
    question_id: str,
    text: str,
    question: str,
    k: int,
    title: Column | None = None,
    tags: Column | None = None,
    boost: Sequence[str] = (),
    context: Column | str | None = None,
) -> DataFrame:
    """Best ``k`` chunks of every question with ``score`` and ``rank``, ties by chunk.

    A task holds ``k`` chunks per question while it reads, so the shuffle carries k rows per question and task. Once a
    question has k, a batch is searched for it only if the most that the batch could give (all its tokens, the best title
    and tag hits of the batch and the best boost) reaches its k-th score. A chunk's boost counts for every question: the
    task keeps the k best boosted chunks once for all questions and adds them at its end. Questions go out in passes of
    bounded size. ``context`` adds its tokens to the question's. A chunk without text tokens is left out, as is a question
    without tokens where no chunk is boosted.
    """
    spark = chunks.sparkSession
    fields = {"_text": (tokens(text), 1.0)}
    if title is not None:
        fields["_title"] = (tokens(title), TITLE_WEIGHT)
    if tags is not None:
        fields["_tags"] = (tokens(F.array_join(tags, " ")), TAG_WEIGHT)
    kinds = (questions.schema[question_id].dataType, chunks.schema[chunk_id].dataType)
    asked_kind = to_arrow_type(kinds[0])
    schema = f"`{question_id}` {kinds[0].simpleString()}, `{chunk_id}` {kinds[1].simpleString()}, score double"
    usable = chunks.select(chunk_id, *[words.alias(name) for name, (words, _) in fields.items()])
    wording = F.col(question) if context is None else F.concat_ws(" ", F.col(question), as_column(context))
    asked = questions.select(question_id, tokens(wording).alias("_q"))
    weights = {name: weight for name, (_, weight) in fields.items()}
    out = None
    for part in collect_passes(asked, [question_id]):
        if not part:
            continue
        shared = spark.sparkContext.broadcast(QuestionTable([r[0] for r in part], [r[1] for r in part], list(boost)))

        def search(batches, shared=shared):
            heap = BestChunks(shared.value, weights, k)
            for batch in batches:
                heap.read(batch.column(chunk_id), {name: batch.column(name) for name in weights})
            yield from heap.rows(question_id, chunk_id, asked_kind)

        found = usable.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return top_k(out, question_id, chunk_id, k)


class QuestionTable:
    """Tokens of a bounded number of questions: which questions hold a token, and how many tokens each has."""

    def __init__(self, ids: list, words: list[list[str]], boost: list[str]):
        self.ids, self.boost = ids, boost
        known = {w: i for i, w in enumerate(dict.fromkeys(w for held in words for w in held))}
        self.words = list(known)
        token = np.array([known[w] for held in words for w in held], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(held) for held in words])
        order = np.argsort(token, kind="stable")
        self.owner, self.first = owner[order], np.searchsorted(token[order], np.arange(len(known) + 1))
        self.size = np.array([len(held) for held in words], np.float64)

    def hits(self, values: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, question) of every token of a list column that a question holds."""
        row = np.repeat(np.arange(len(values)), np.nan_to_num(pc.list_value_length(values).to_numpy(zero_copy_only=False)).astype(np.int64))
        token = pc.index_in(values.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, token = row[token >= 0], token[token >= 0]
        count = self.first[token + 1] - self.first[token]
        at = np.repeat(self.first[token] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(token) else token, count) + np.arange(count.sum())
        return np.repeat(row, count), self.owner[at]


class BestChunks:
    """The ``k`` best chunks of each question among those read so far, and the best boosted chunks of all."""

    def __init__(self, asked: QuestionTable, weights: Mapping[str, float], k: int):
        self.asked, self.weights, self.k = asked, weights, k
        self.vocabulary = pa.array(asked.words, pa.string())
        self.question, self.score, self.pool = np.zeros(0, np.int64), np.zeros(0), None
        self.boosted, self.boost_score = None, np.zeros(0)
        self.least = np.full(len(asked.ids), -np.inf)

    def _summed(self, row: np.ndarray, question: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.unique(row * len(self.asked.ids) + question, return_inverse=True)
        return key // len(self.asked.ids), key % len(self.asked.ids), np.bincount(place, weight, len(key))

    def read(self, ids: pa.Array, lists: Mapping[str, pa.ListArray]) -> None:
        asked = self.asked
        has_text = np.nan_to_num(pc.list_value_length(lists["_text"]).to_numpy(zero_copy_only=False)) > 0
        bonus = np.zeros(len(ids))
        if asked.boost and "_tags" in lists:
            tags = lists["_tags"]
            row = np.repeat(np.arange(len(tags)), np.nan_to_num(pc.list_value_length(tags).to_numpy(zero_copy_only=False)).astype(np.int64))
            wanted = pc.is_in(tags.flatten(), value_set=pa.array(asked.boost, pa.string())).to_numpy(zero_copy_only=False)
            bonus = np.bincount(row[wanted.astype(bool)], minlength=len(ids)) * BOOST_WEIGHT
        found = []
        for name in [n for n in self.weights if n != "_text"]:
            row, question = asked.hits(lists[name], self.vocabulary)
            found.append((row, question, np.full(len(row), self.weights[name])))
        row, question, weight = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        row, question, weight = self._summed(row, question, weight)
        most = np.zeros(len(asked.ids))
        np.maximum.at(most, question, weight)
        # the most that this batch can give a question; a tie may still win by its chunk id
        live = asked.size + most + (bonus.max() if len(bonus) else 0) >= self.least - 1e-9
        text_row, text_question = asked.hits(lists["_text"], self.vocabulary) if live.any() else (np.zeros(0, np.int64),) * 2
        ok = live[text_question]
        text_row, text_question = text_row[ok], text_question[ok]
        row, question, score = self._summed(np.append(row, text_row), np.append(question, text_question), np.append(weight, np.ones(len(text_row))))
        score = np.round(score + bonus[row], 9)
        ok = has_text[row] & live[question] & (score >= self.least[question])
        self._keep(question[ok], score[ok], ids.take(pa.array(row[ok])))
        some = np.flatnonzero(has_text & (bonus > 0))
        if len(some):
            held, scores = ids.take(pa.array(some)), bonus[some]
            if self.boosted is not None:
                held, scores = pa.concat_arrays([self.boosted, held]), np.append(self.boost_score, scores)
            order = np.lexsort((self._places(held), -scores))[: self.k]
            self.boosted, self.boost_score = held.take(pa.array(order)), scores[order]

    @staticmethod
    def _places(ids: pa.Array) -> np.ndarray:
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        return place

    def _keep(self, question: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        pool = ids if self.pool is None else pa.concat_arrays([self.pool, ids])
        question, score = np.append(self.question, question), np.append(self.score, score)
        order = np.lexsort((self._places(pool), -score, question))
        grouped = question[order]
        begin = np.searchsorted(grouped, grouped)
        order = order[np.arange(len(order)) - begin < self.k]
        self.question, self.score, self.pool = question[order], score[order], pool.take(pa.array(order))
        count = np.bincount(self.question, minlength=len(self.asked.ids))
        last = np.cumsum(count) - 1
        full = np.flatnonzero(count == self.k)
        self.least[full] = self.score[last[full]]

    def rows(self, question_id: str, chunk_id: str, kind: pa.DataType, step: int = 100_000):
        if self.boosted is not None:
            n, b = len(self.asked.ids), len(self.boosted)
            known = {(int(q), x) for q, x in zip(self.question, self.pool.to_pylist(), strict=True)}
            new = [(q, j) for j, x in enumerate(self.boosted.to_pylist()) for q in range(n) if (q, x) not in known] if b else []
            if new:
                q, j = np.array(new).T
                self._keep(q, self.boost_score[j], self.boosted.take(pa.array(j)))
        for a in range(0, len(self.question), step):
            names = [self.asked.ids[i] for i in self.question[a : a + step].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), self.pool.slice(a, step), pa.array(self.score[a : a + step])], names=[question_id, chunk_id, "score"])


def top_k(scores: DataFrame, group: str, item: str, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` per group, ties by item; a partial top-k runs before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within_budget(ranked: DataFrame, group: str, text: str, budget: int, k: int, chars: int = SNIPPET_CHARS) -> DataFrame:
    """First ``k`` non-blank ranked rows taken while the snippets before them are shorter than ``budget``.

    ``ranked`` holds a bounded number of rows per group (three times ``k``).
    """
    rows = ranked.where((F.col("rank") <= 3 * k) & (F.length(F.trim(text)) > 0)).withColumn(
        "snippet", F.substring(F.trim(F.col(text)), 1, chars)
    )
    order = Window.partitionBy(group).orderBy("rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("snippet")).over(before), F.lit(0))
    rows = rows.withColumns({"used_before": used, "place": F.row_number().over(order)})
    return rows.where((F.col("used_before") < budget) & (F.col("place") <= k))


def fused_scores(lexical: DataFrame, vector: DataFrame, keys: Sequence[str], weight: float = 0.5) -> DataFrame:
    """Weighted sum of both scores, each divided by the group's best; a missing side counts as zero."""
    group = Window.partitionBy(keys[0])
    left = lexical.select(*keys, (F.col("score") / F.max("score").over(group)).alias("_a"))
    right = vector.select(*keys, (F.col("score") / F.max("score").over(group)).alias("_b"))
    return left.join(right, list(keys), "full").select(
        *keys, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score")
    )


def with_distinct_terms(frame: DataFrame, terms: Column, out: str = "query_text", limit: int = 40) -> DataFrame:
    """First ``limit`` trimmed terms, repeats ignored without regard to case, first spelling kept, space joined."""
    cleaned = F.filter(F.transform(terms, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: F.length(t) > 0)
    staged = frame.withColumn("_terms", cleaned).withColumn("_low", F.transform("_terms", lambda t: F.lower(t)))
    staged = staged.withColumn("_first", F.slice(F.array_distinct("_low"), 1, limit))
    spelled = F.transform("_first", lambda w: F.element_at("_terms", F.array_position("_low", w).cast("int")))
    return staged.withColumn(out, F.array_join(spelled, " ")).drop("_terms", "_low", "_first")


# Terms opening every retrieval query.
BASE_TERMS = (
    "UITI", "UITI_VANO", "impacto", "confiabilidad", "calidad del servicio", "interrupciones", "duracion fuente",
    "usuarios afectados", "mantenimiento",
)


def citation_rows(chunks: DataFrame, group: str, list_column: str) -> DataFrame:
    """(group, citation number from 1, id, title, score, snippet) from an ordered list of chunk structs."""
    item = F.col("_c")
    return chunks.select(group, F.posexplode(list_column).alias("_i", "_c")).select(
        group,
        (F.col("_i") + 1).alias("citation_no"),
        F.coalesce(item["chunk_id"], F.concat(F.lit("doc-"), (F.col("_i") + 1).cast("string"))).alias("id"),
        F.coalesce(item["title"], F.lit("Documento técnico")).alias("title"),
        F.substring(F.coalesce(item["text"], F.lit("")), 1, SNIPPET_CHARS).alias("snippet"),
        F.coalesce(item["score"], F.lit(0.0)).alias("score"),
    )


def sentences(value: Column | str) -> Column:
    """Sentences of the non-heading lines."""
    lines = F.transform(F.split(F.coalesce(as_column(value), F.lit("")), "\\r\\n|\\n|\\r"), squeeze)
    kept = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    parts = F.flatten(F.transform(kept, lambda x: F.split(x, "(?<=[.!?])\\s+")))
    return F.filter(F.transform(parts, F.trim), lambda x: F.length(x) > 0)


# Terms marking normative and documentary claims.
NORMATIVE_TERMS = ("creg", "retie", "norma", "normativa", "regulatorio", "regulatoria", "requisito", "cumplimiento")
DOCUMENTARY_TERMS = ("documento", "bitacora", "registro", "mantenimiento", "evidencia documental")


def _uncited(value: Column | str, terms: Sequence[str]) -> Column:
    def claims(s: Column) -> Column:
        text = plain_text(s)
        test = F.lit(False)
        for term in terms:
            test = test | text.contains(term)
        return test & ~s.rlike("\\[\\d{1,3}\\]")

    return F.slice(F.transform(F.filter(sentences(value), claims), lambda s: F.substring(s, 1, 260)), 1, 5)


def check_citations(
    answers: DataFrame, text: str, available: str, normative: Sequence[str] = NORMATIVE_TERMS, documentary: Sequence[str] = DOCUMENTARY_TERMS
) -> DataFrame:
    """Used, unknown and placeholder citations, uncited claims (five at most), errors and verdict per text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit("\\[(\\d{1,3})\\]"), 1), lambda x: x.cast("int"))))
    marks = F.regexp_extract_all(raw, F.lit("(?i)(\\[(?:x|xx|citation|cita|pendiente)\\])"), 1)
    out = answers.withColumns(
        {
            "used_citations": used,
            "placeholders": F.array_sort(F.array_distinct(marks)),
            "uncited_normative": _uncited(text, normative),
            "uncited_documentary": _uncited(text, documentary),
        }
    ).withColumn("unknown_citations", F.filter("used_citations", lambda n: (n < 1) | (n > F.col(available))))
    errors = F.array_compact(
        F.array(
            F.when(F.size("placeholders") > 0, F.lit("placeholder_citations")),
            F.when(F.size("unknown_citations") > 0, F.lit("citation_index_out_of_range")),
            F.when(F.size("uncited_normative") > 0, F.lit("uncited_normative_claim")),
            F.when(F.size("uncited_documentary") > 0, F.lit("uncited_documentary_claim")),
        )
    )
    return out.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


# Claim classes in the order they are tried, with the words that give them.
CLAIM_CLASSES = (
    ("definitive_causality", None, r"(?i)\b(causo definitivamente|causa fue|demuestra que|prueba que)\b"),
    (
        "definitive_legal_conclusion",
        None,
        r"(?i)\b(incumplimiento confirmado|responsabilidad legal|sancion aplicable|no cumple|cumple)\b",
    ),
    ("normative_claim", ("creg", "retie", "norma", "normativa", "regulatorio", "requisito"), None),
    ("documentary_claim", ("documento", "bitacora", "mantenimiento", "registro", "evidencia documental"), None),
    ("model_claim", ("modelo", "prediccion", "mascara", "relevancia", "feature"), None),
    ("field_inspection_claim", ("inspeccion", "campo", "cuadrilla"), None),
    ("structured_observation", ("uiti", "saidi", "saifi", "duracion", "usuarios", "circuito"), None),
)
FORBIDDEN_PATTERNS = (
    CLAIM_CLASSES[0][2],
    CLAIM_CLASSES[1][2],
    r"(?i)\b(el modelo demuestra|la prediccion prueba|la mascara prueba)\b",
    r"(?i)\b(se inspecciono en campo|la cuadrilla confirmo|visita de campo confirmo)\b",
)
REQUIRED_EVIDENCE = {
    "definitive_causality": "structured_observation,documentary_evidence,model_signal",
    "definitive_legal_conclusion": "normative_evidence",
    "normative_claim": "normative_evidence",
    "documentary_claim": "documentary_evidence",
    "model_claim": "model_signal",
    "field_inspection_claim": "documentary_evidence",
    "structured_observation": "structured_observation",
    "general_interpretation": "llm_interpretation",
}


def classify_claims(texts: DataFrame, text: str, classes: Sequence[tuple] = CLAIM_CLASSES) -> DataFrame:
    """First matching claim class, whether a forbidden claim is made, and the evidence the class needs."""
    texts = texts.withColumns({"_raw": F.coalesce(F.col(text), F.lit("")), "_normal": plain_text(text)})
    raw, normal = F.col("_raw"), F.col("_normal")
    choice = None
    for name, words, pattern in classes:
        if pattern:
            test = raw.rlike(pattern)
        else:
            test = F.lit(False)
            for w in words:
                test = test | normal.contains(w)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    forbidden = F.lit(False)
    for pattern in FORBIDDEN_PATTERNS:
        forbidden = forbidden | raw.rlike(pattern)
    table = F.create_map(*[F.lit(x) for item in REQUIRED_EVIDENCE.items() for x in item])
    return texts.withColumns(
        {"claim_type": choice.otherwise("general_interpretation"), "forbidden_claim": forbidden}
    ).drop("_raw", "_normal").withColumn("required_evidence", F.coalesce(table[F.col("claim_type")], F.lit("llm_interpretation")))


# Compliance wording that is blocked, and wording that is allowed.
BLOCKED_WORDING = (
    ("incumplimiento confirmado", r"\bincumplimiento\s+confirmado\b"),
    ("no cumple", r"\bno\s+cumple\b"),
    ("cumple", r"(?<!no )\bcumple\b"),
    ("sanción aplicable", r"\bsancion\s+aplicable\b"),
    ("responsabilidad legal demostrada", r"\bresponsabilidad\s+legal\s+demostrada\b"),
)
ALLOWED_WORDING = (
    "posible riesgo",
    "evidencia disponible",
    "bandera de evidencia",
    "dato faltante",
    "recomendación de verificación",
    "recomendacion de verificacion",
)


def unaccented(value: Column | str) -> Column:
    """Lower case without accents, whitespace squeezed, other signs kept."""
    from gridpulse.functions.text import ACCENTED, PLAIN

    text = F.translate(F.lower(F.coalesce(as_column(value), F.lit(""))), ACCENTED, PLAIN)
    return squeeze(F.regexp_replace(text, "\\p{Mn}+", ""))


def check_wording(
    texts: DataFrame, text: str, blocked: Sequence[tuple[str, str]] = BLOCKED_WORDING, allowed: Sequence[str] = ALLOWED_WORDING
) -> DataFrame:
    texts = texts.withColumn("_normal", unaccented(text))
    normal = F.col("_normal")
    flagged = F.array_compact(F.array(*[F.when(normal.rlike(p), F.lit(name)) for name, p in blocked]))
    present = F.array_compact(F.array(*[F.when(normal.contains(p), F.lit(p)) for p in allowed]))
    return texts.withColumns({"flagged": flagged, "allowed_present": present, "wording_ok": F.size(flagged) == 0}).drop("_normal")


# Answer sections in order, their titles, default items and further headings.
SECTIONS = {
    "estado_observado": ("Estado observado", "No se identificó una sección específica de estado observado."),
    "banderas_evidencia": ("Banderas de evidencia", "Sin banderas de evidencia adicionales reportadas."),
    "requisitos_posiblemente_aplicables": (
        "Requisitos posiblemente aplicables",
        "Sin requisitos posiblemente aplicables adicionales identificados.",
    ),
    "datos_faltantes": ("Datos faltantes", "No se reportaron datos faltantes adicionales."),
    "riesgo_posible": ("Riesgo posible", "Sin riesgo posible adicional identificado con la evidencia disponible."),
    "recomendaciones": ("Recomendaciones", "Sin recomendaciones adicionales reportadas."),
    "limitaciones": ("Limitaciones", "La respuesta debe revisarse contra la evidencia disponible."),
    "citas_usadas": ("Citas usadas", "Sin citas documentales recuperadas."),
    "preguntas_sugeridas": ("Preguntas sugeridas", "Sin preguntas sugeridas adicionales."),
}
HEADING_ALIASES = {
    "citas": "citas_usadas",
    "fuentes usadas": "citas_usadas",
    "preguntas de seguimiento": "preguntas_sugeridas",
    "preguntas sugeridas de seguimiento": "preguntas_sugeridas",
    "recomendaciones de verificacion": "recomendaciones",
    "riesgos posibles": "riesgo_posible",
}
BULLET = "^\\s*(?:[-*•]+|\\d+[.)])\\s*"


def _heading_table() -> Column:
    names = {title.lower(): key for key, (title, _) in SECTIONS.items()}
    names |= {key.replace("_", " "): key for key in SECTIONS}
    names |= HEADING_ALIASES
    return F.create_map(*[F.lit(x) for item in names.items() for x in item])


def answer_sections(answers: DataFrame, answer_id: str, text: str) -> DataFrame:
    """(answer, section, items, missing) for the nine sections of every answer.

    A heading line opens a section, inline text after its colon is the first line. Bullets are items of
    their own, other lines join into paragraphs. Text without any heading belongs to the first section;
    sections without items get their default item and are marked missing.
    """
    lines = answers.select(
        answer_id, F.posexplode(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), "\\r\\n|\\n|\\r")).alias("_no", "_line")
    )
    bare = F.trim(F.regexp_replace(F.trim("_line"), "^\\s{0,3}#{1,6}\\s*", ""))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, "[*_`]+", "")), BULLET, ""))
    table = _heading_table()
    label = F.trim(F.regexp_extract(F.col("_bare"), "^([^:]*)", 1))
    rest = F.when(F.col("_bare").contains(":"), F.trim(F.regexp_extract(F.col("_bare"), "^[^:]*:(.*)$", 1))).otherwise("")
    by_label, by_all = table[unaccented(label)], table[unaccented("_bare")]
    lines = lines.withColumn("_bare", bare).withColumns(
        {
            "_head": F.when(F.length("_bare") > 0, F.coalesce(by_label, by_all)),
            "_rest": F.when(by_label.isNotNull(), rest).otherwise(""),
        }
    )
    # one answer's lines stay together: a partition key never holds more than one text
    order = Window.partitionBy(answer_id).orderBy("_no")
    lines = lines.withColumns(
        {
            "_section": F.last("_head", ignorenulls=True).over(order),
            "_any": F.max(F.col("_head").isNotNull()).over(Window.partitionBy(answer_id)),
        }
    )
    content = F.when(F.col("_head").isNotNull(), F.col("_rest")).otherwise(F.trim("_line"))
    lines = lines.withColumns(
        {
            "_section": F.when(F.col("_any"), F.col("_section")).otherwise(F.lit(next(iter(SECTIONS)))),
            "_text": content,
        }
    ).where("_section is not null")
    bullet = F.col("_text").rlike(BULLET)
    inside = Window.partitionBy(answer_id, "_section").orderBy("_no")
    before = F.lag(F.struct(bullet.alias("b"), (F.length("_text") == 0).alias("e"), F.col("_head").isNotNull().alias("h"))).over(inside)
    filled = F.length("_text") > 0
    starts = filled & (bullet | before.isNull() | before["b"] | before["e"])
    lines = lines.withColumn("_item", F.sum(starts.cast("int")).over(inside)).where(filled)
    items = lines.groupBy(answer_id, "_section", "_item").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_no", F.trim(F.regexp_replace("_text", BULLET, "")).alias("t")))),
                lambda s: s["t"],
            ),
            " ",
        ).alias("_t")
    )
    compact = F.when(F.length(squeeze("_t")) <= 900, squeeze("_t")).otherwise(
        F.concat(F.rtrim(F.substring(squeeze("_t"), 1, 897)), F.lit("..."))
    )
    items = items.withColumn("_t", compact).where(F.length("_t") > 0)
    found = items.groupBy(answer_id, F.col("_section").alias("section")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_item", "_t"))), lambda s: s["_t"]).alias("_items")
    )
    names = F.array(*[F.lit(k) for k in SECTIONS])
    defaults = F.create_map(*[F.lit(x) for k, (_, d) in SECTIONS.items() for x in (k, d)])
    return (
        answers.select(answer_id, F.explode(names).alias("section"))
        .join(found, [answer_id, "section"], "left")
        .select(
            answer_id,
            "section",
            F.coalesce("_items", F.array(defaults[F.col("section")])).alias("items"),
            F.col("_items").isNull().alias("missing"),
        )
    )


# Routing terms per tool, in the order tools are offered.
ROUTES = {
    "get_dashboard_context": (
        "dashboard", "vista", "kpi", "indicador", "indicadores", "municipio", "periodo", "concentracion", "valores",
    ),
    "get_reliability_summary": (
        "confiabilidad", "uiti", "impacto", "recurrencia", "recurrente", "historico", "circuitos",
    ),
    "get_compliance_context": (
        "cumplimiento", "regulatorio", "regulatoria", "norma", "requisito", "riesgo", "creg", "retie",
    ),
    "get_event_context": (
        "evento", "falla", "causa", "duracion", "interrupcion",
    ),
    "get_asset_context": (
        "activo", "equipo", "transformador", "apoyo", "seccionador", "linea", "revisar", "revision",
    ),
    "get_circuit_history": (
        "historial", "historico", "recurrencia", "recurrente", "circuito",
    ),
    "get_timeseries_interpretability_context": (
        "evolucion", "serie", "tendencia", "pico", "picos", "anomalia", "critico", "criticos", "uiti", "impacto",
    ),
    "get_prediction_context": (
        "prediccion", "predictivo", "modelo", "riesgo", "score",
    ),
    "get_feature_mask_context": (
        "mascara", "relevancia", "importancia", "atribucion", "features",
    ),
    "get_three_way_synthesis_context": (
        "sintesis", "causal", "causalidad", "integrada", "tres",
    ),
    "get_intervention_candidate_context": (
        "intervencion", "candidato", "accion", "mitigar",
    ),
    "get_what_if_context": (
        "what-if", "whatif", "simulacion", "escenario", "delta",
    ),
    "get_evidence_report_context": (
        "reporte", "informe", "evidencia", "generar",
    ),
    "search_regulatory_documents": (
        "creg", "retie", "regulatorio", "regulatoria", "regulacion", "norma", "normativo", "normativa", "requisito",
        "cumplimiento", "calidad", "uiti", "impacto",
    ),
    "search_technical_documents": (
        "documento", "evidencia", "cita", "citar", "manual", "indicador", "indicadores", "tecnico", "mantenimiento",
        "inspeccion", "condiciones", "viento", "red", "revision", "campo", "activo",
    ),
}
# The second tool is offered only where the first is not.
EXCLUSIVE = ("search_regulatory_documents", "search_technical_documents")


def route_tools(texts: DataFrame, text: str, routes: Mapping[str, Sequence[str]] = ROUTES, exclusive: tuple[str, str] = EXCLUSIVE) -> DataFrame:
    """Adds ``tools``: tools whose terms meet the text's tokens, each once, in route order."""
    texts = texts.withColumn("_words", F.array_distinct(F.split(plain_text(text), " ")))
    words = F.col("_words")
    picks = []
    for tool, terms in routes.items():
        test = F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))
        if tool == exclusive[1] and exclusive[0] in routes:
            test = test & ~F.arrays_overlap(words, F.array(*[F.lit(t) for t in routes[exclusive[0]]]))
        picks.append(F.when(test, F.lit(tool)))
    return texts.withColumn("tools", F.array_compact(F.array(*picks))).drop("_words")


def search_by_tokens(frame: DataFrame, columns: Sequence[str], query: str | None) -> DataFrame:
    """Rows whose tokens overlap the query's; a query without tokens passes every row."""
    asked = tokens(F.lit(query or ""))
    text = tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return frame.where((F.size(asked) == 0) | F.arrays_overlap(text, asked))


def mask_rows(frame: DataFrame, row_id: str, payload: str) -> DataFrame:
    """Feature scores from JSON, either a list of numbers or objects, or a map; non-numeric ones are left out."""
    raw = F.col(payload)
    as_list = F.from_json(raw, "array<string>")
    as_map = F.from_json(raw, "map<string,string>")
    is_list = F.trim(raw).startswith("[")
    entries = F.when(
        is_list,
        F.transform(as_list, lambda v, i: F.struct(F.concat(F.lit("feature_"), i.cast("string")).alias("name"), v.alias("value"))),
    ).otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    rows = frame.select(row_id, is_list.alias("_l"), F.posexplode(entries).alias("position", "_e"))
    value = F.col("_e.value")
    obj = F.trim(value).startswith("{")

    def field(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(value, f"$.{n}"), F.lit("")) for n in names])

    name = F.when(F.col("_l") & obj, F.coalesce(field("feature_name", "feature", "name", "variable"), F.col("_e.name"))).otherwise(F.col("_e.name"))
    score = F.when(obj, field("relevance_score", "score", "importance", "value")).otherwise(value).try_cast("double")
    mode = F.when(obj, field("mode", "group"))
    return rows.select(
        row_id, "position", name.alias("feature_name"), score.alias("relevance_score"),
        F.coalesce(mode, F.lit("model_signal")).alias("mode"),
    ).where("relevance_score is not null")


def bounded_memory(messages: DataFrame, conversation: str, turn: str, role: str, text: str, turns: int, topic_chars: int = 220) -> DataFrame:
    """Last ``2 * turns`` messages per conversation plus one digest row for the messages left out.

    The recent rows are a partial top-k, the rest is summed up by mergeable aggregates only, so a very long
    conversation never gathers in one task. The digest id hashes the combined message hashes. Messages of one turn are
    ordered by a hash of their role and text; equal ones are messages like others. Topics are cut at ``topic_chars``.
    """
    mark = F.md5(F.concat_ws(":", F.col(turn).cast("string"), F.col(role), F.col(text)))
    rows = messages.select(conversation, turn, role, text).withColumn("_order", F.struct(F.col(turn), mark))
    back = Window.partitionBy(conversation).orderBy(F.desc("_order"))
    recent = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= 2 * turns).drop("_back")
    cut = recent.groupBy(conversation).agg(F.min("_order").alias("_cut"), F.count(F.lit(1)).alias("_all"))
    at_cut = recent.join(cut, conversation).where(F.col("_order") == F.col("_cut")).groupBy(conversation).agg(F.count(F.lit(1)).alias("_held"))
    cut = cut.select(conversation, "_cut").join(at_cut, conversation)
    brief = F.substring(squeeze(text), 1, topic_chars)
    number = F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")
    # copies of the oldest recent message that are not recent themselves are left out too
    early, equal = F.col("_order") < F.col("_cut"), F.col("_order") == F.col("_cut")
    more = F.count_if(equal) - F.max("_held")

    def counted(test: Column) -> Column:
        return F.count_if(early & test) + F.when(F.bool_or(equal & test), more).otherwise(0)

    left = (
        rows.join(cut, conversation)
        .where(early | equal)
        .groupBy(conversation)
        .agg(
            counted(F.lit(True)).alias("n"),
            counted(F.coalesce(F.col(role) == "user", F.lit(False))).alias("users"),
            counted(F.coalesce(F.col(role) == "assistant", F.lit(False))).alias("assistants"),
            F.min_by(brief, F.col("_order")).alias("first"),
            F.when(more > 0, F.max_by(brief, F.col("_order"))).otherwise(F.max_by(F.when(early, brief), F.when(early, F.col("_order")))).alias("last"),
            F.bit_xor(F.when(early, number)).alias("mark"),
        )
        .where("n > 0")
        .withColumn("mark", F.coalesce("mark", F.lit(0)))
    )
    none = F.lit("N/D")
    digest = left.select(
        conversation,
        F.concat(F.lit("memory-"), F.substring(F.sha2(F.concat_ws("|", "n", "mark"), 256), 1, 16)).alias("turn_id"),
        F.lit("assistant").alias(role),
        F.concat(
            F.lit("Memoria compacta deterministica: "), F.col("n").cast("string"), F.lit(" mensajes previos omitidos ("),
            F.col("users").cast("string"), F.lit(" usuario, "), F.col("assistants").cast("string"),
            F.lit(" asistente). Primer tema: "), F.coalesce(F.nullif(F.col("first"), F.lit("")), none),
            F.lit(". Ultimo tema antes del historial reciente: "), F.coalesce(F.nullif(F.col("last"), F.lit("")), none), F.lit("."),
        ).alias("content"),
    )
    return digest.unionByName(
        recent.select(conversation, F.col(turn).cast("string").alias("turn_id"), role, F.col(text).alias("content"))
    )


def grounding_errors(narratives: DataFrame, points: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Errors of narrated points: unknown day, wrong rank, citation out of range, forbidden phrase.

    ``narratives``: series, day, rank, citations array, n_citations, text. ``points``: series, day, rank.
    """
    known = points.select("series", "day", F.col("rank").alias("_rank"))
    joined = narratives.join(known, ["series", "day"], "left")
    day = F.col("day").cast("string")
    bad_citations = F.transform(
        F.filter("citations", lambda c: (c < 1) | (c > F.col("n_citations"))),
        lambda c: F.concat(F.lit("invalid_citation:"), c.cast("string")),
    )
    phrases = F.array_compact(
        F.array(*[F.when(F.lower("text").contains(p), F.lit(f"forbidden_phrase:{p}")) for p in forbidden])
    )
    own = F.array_compact(
        F.array(
            F.when(F.col("_rank").isNull(), F.concat(F.lit("point_narrative_date_not_grounded:"), day)),
            F.when(F.col("_rank") != F.col("rank"), F.concat(F.lit("point_rank_mismatch:"), day)),
        )
    )
    return joined.select("series", "day", F.explode(F.concat(own, bad_citations, phrases)).alias("error"))
