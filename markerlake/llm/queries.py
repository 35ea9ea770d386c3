"""The queries of this subpackage's operators over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.llm import bpe, decontaminate, divergence, katz, langid, neardup, pages, pii, repair, spelling, token_counts, topk, toxicity
from markerlake.llm.common import table

#: Where the tokenizers' files are on every machine; a parameter of the operators, set here for the queries.
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_katz": op2_katz,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_repair": op6_repair,
    "op7_minhash": op7_minhash,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_main_text": op12_main_text,
    "op13_spelling": op13_spelling,
}

#: DuckDB SQL for the same rows, where SQL expresses them and whole tables aren't too slow for it.
ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.place AS place, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), t AS (
            SELECT place, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT place) >= 3
        ), v AS (
            SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
        ), c AS (
            SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT o.lang, o.source, v.v, v.total AS lang_total, coalesce(x.total, 0) AS total
            FROM (SELECT DISTINCT lang, source FROM d) o JOIN v USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x ON x.lang = o.lang AND x.source = o.source
        ), every AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
                   1 + 1000000000::HUGEINT * (k.n + 1) // (g.lang_total + g.v) AS q
            FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM every WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_spelling": r"""
        WITH RECURSIVE runs AS (
            SELECT doc, run, count(*) AS times FROM (
                SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
                       translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents
            ) WHERE length(run) >= 5 GROUP BY doc, run
        ), crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
        ), hashed AS (
            SELECT doc, run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
            FROM (
                SELECT doc, run, times, flatten(list_transform(string_split(doc || ':' || run, ''),
                           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)]::BIGINT[] END)) AS bytes
                FROM runs
            ), crc
        ), words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
            ) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ), keys AS (
            SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:]))) AS key FROM words
        ), near AS (
            SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n
            FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
            WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1
        ), best AS (
            SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM near GROUP BY word, n
        ), formed AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), ways AS (
            SELECT word, word AS at FROM formed
            UNION ALL
            SELECT y.word, f.form FROM ways y JOIN formed f ON f.word = y.at WHERE f.form IS NOT NULL
        ), ends AS (
            SELECT y.word, y.at AS root FROM ways y JOIN formed f ON f.word = y.at WHERE f.form IS NULL
        )
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
    """,
}
