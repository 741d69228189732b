"""The corpus operators bound to the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridpulse.llm import captures, fingerprints, jaccard, languages, leaks, licenses, manifest, onehash, packing, prefixes, quality, substrings, suffixes

TOKENIZER = "word_bpe_49k.json"

CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
   lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
"""Unsigned CRC-32 of an ASCII text in SQL."""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_substring_dedup")
def _(spark, folder):
    return substrings.digest_rows(substrings.substring_dedup(table(spark, folder, "documents")))


@query("op7_suffix_dedup")
def _(spark, folder):
    return suffixes.digest_rows(suffixes.suffix_dedup(table(spark, folder, "documents")))


@query("op3_license_scan")
def _(spark, folder):
    return licenses.query_rows(licenses.license_scan(table(spark, folder, "documents")))


@query("op4_language_id")
def _(spark, folder):
    return languages.identify_languages(table(spark, folder, "documents"))


@query("op6_quality")
def _(spark, folder):
    return quality.with_prediction(
        quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    )


@query(
    "op5_warc_captures",
    """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
 FROM pages),
h AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id > head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)""",
)
def _(spark, folder):
    return captures.query_rows(captures.captures(table(spark, folder, "pages")))


@query("op8_best_fit_packing")
def _(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


@query("op9_imatch_fingerprints")
def _(spark, folder):
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query("op2_jaccard_join")
def _(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op10_benchmark_leaks")
def _(spark, folder):
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op12_merkle_manifest",
    f"""
WITH RECURSIVE fields AS (
 SELECT doc_id, source, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head
 FROM documents),
leaves AS (
 SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN {CRC.format('doc_id::VARCHAR')} % 5 = 0
   THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
 FROM fields),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaves),
up AS (
 SELECT s, 0 AS lvl, p, n, leaf AS h FROM placed
 UNION ALL
 SELECT s, lvl + 1, p // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY s, lvl, p // 16),
tops AS (
 SELECT 0 AS lvl, s AS p, count(*) OVER () AS n, h FROM up WHERE n = 1
 UNION ALL
 SELECT lvl + 1, p // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY lvl, p // 16),
nodes AS (
 SELECT s, lvl, p, n, h FROM up
 UNION ALL
 SELECT -1, lvl, p, n, h FROM tops),
runs AS (
 SELECT s, lvl, p // 16 AS run, list(h ORDER BY p) AS hs FROM nodes WHERE n > 1 GROUP BY s, lvl, p // 16),
walk AS (
 SELECT doc_id, leaf, coalesce(altered, leaf) AS h, s AS source_no, p AS leaf_no, s AS tree, 0 AS lvl, p, n, '' AS proof FROM placed
 UNION ALL
 SELECT w.doc_id, w.leaf,
  CASE WHEN w.n > 1 THEN sha256(array_to_string(r.hs[:(w.p % 16)::BIGINT], '') || w.h || array_to_string(r.hs[(w.p % 16 + 2)::BIGINT:], '')) ELSE w.h END,
  w.source_no, w.leaf_no, CASE WHEN w.n > 1 THEN w.tree ELSE -1 END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END,
  CASE WHEN w.n > 1 THEN w.p // 16 ELSE w.source_no END, CASE WHEN w.n > 1 THEN (w.n + 15) // 16 ELSE t.n END,
  CASE WHEN w.n > 1 THEN w.proof || array_to_string(r.hs[:(w.p % 16)::BIGINT], '') || array_to_string(r.hs[(w.p % 16 + 2)::BIGINT:], '') ELSE w.proof END
 FROM walk w LEFT JOIN runs r ON r.s = w.tree AND r.lvl = w.lvl AND r.run = w.p // 16 LEFT JOIN tops t ON t.lvl = 0 AND t.p = w.source_no
 WHERE w.n > 1 OR w.tree >= 0)
SELECT w.doc_id, w.leaf, u.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN up u ON u.s = w.source_no AND u.n = 1 JOIN tops t ON t.n = 1
WHERE w.tree = -1 AND w.n = 1""",
)
def _(spark, folder):
    return manifest.proof_rows(manifest.build_manifest(table(spark, folder, "documents")))


@query(
    "op11_prefix_trie",
    f"""
WITH own AS (
 SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
family AS (
 SELECT o.c, o.l, coalesce(b.l, []) AS base, ({CRC.format('o.c::VARCHAR')} % 9)::BIGINT AS h
 FROM own o LEFT JOIN own b ON b.c = o.c - ((o.c % 5) + 5) % 5),
rebuilt AS (SELECT c, list_concat(base[:h], l[h + 1:]) AS l FROM family),
prefixes AS (
 SELECT c, d, l[:d] AS key, len(l) = d AS over, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS size
 FROM rebuilt, unnest(range(len(l) + 1)) AS u(d)),
nodes AS (
 SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, bool_and(over) AS leaf,
  sha256(coalesce(string_agg(CASE WHEN over THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
 FROM prefixes GROUP BY key),
sums AS (
 SELECT key[:k] AS key, sum((n - 1) * size)::BIGINT AS saved_tokens, (count(*) FILTER (leaf))::BIGINT AS n_leaves,
  (count(*) FILTER (k = depth - 1))::BIGINT AS n_children
 FROM nodes, unnest(range(depth + 1)) AS u(k) GROUP BY key[:k])
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[:n.depth - 1]""",
)
def _(spark, folder):
    return prefixes.prefix_nodes(table(spark, folder, "conversations"))


@query(
    "op13_onehash_components",
    r"""
WITH RECURSIVE words AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
 SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
 FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
 SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv
 FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (nu + nv - c)),
edges AS (
 SELECT u, v FROM links
 UNION ALL
 SELECT v, u FROM links),
reached AS (
 SELECT doc_id, doc_id AS other FROM documents
 UNION
 SELECT r.doc_id, e.v FROM reached r JOIN edges e ON e.u = r.other),
heads AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN heads USING (doc_id)""",
)
def _(spark, folder):
    return onehash.near_duplicate_components(table(spark, folder, "documents"))
