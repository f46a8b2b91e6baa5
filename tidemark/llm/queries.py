"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie, exact_dedup, fingerprints, html_extract, importance, line_dedup, near_dedup, packing, pii, quality, simhash, tokens, toxicity
from tidemark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: The key of the pseudonyms; a deployment sets its own.
PII_KEY = "tidemark-pseudonyms-1"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"), least=3, share=0.3)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"), least=0.8, n_bands=30, band_rows=6)
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"), PII_KEY)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE, outputs=False)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=0, cached=128 << 20, together=4 << 20)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lines = line_dedup.drop_lines(documents, line_dedup.batches_of(spark, f"{sf_dir}/documents.parquet", 4), least=20, enough=3)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), radius=3, n_words=3)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, seed=7)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), family=5, modulus=9)


#: CRC-32 in SQL: a table of 256 steps made from its polynomial, and `crc`, which folds a list of bytes over it.
CRC = """
    crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                   lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    )
"""


def crc(of_bytes: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


SQL = {
    "op12_importance_resampling": f"""
        WITH {CRC}, texts AS (
            SELECT 'd' AS of, row_number() OVER () AS n, doc_id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
        ), worded AS (
            SELECT of, n, doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
        ), features AS (
            SELECT of, n, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
            FROM worded
        ), known AS (
            SELECT feature, {crc("list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)")} % 10000 AS bucket
            FROM (SELECT DISTINCT feature FROM features), crc_table
        ), counted AS (
            SELECT bucket, count(*) FILTER (of = 'd') AS s, count(*) FILTER (of = 'b') AS t
            FROM features JOIN known USING (feature) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM counted
        ), summed AS (
            SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS g
            FROM features JOIN known USING (feature) JOIN gains USING (bucket) WHERE of = 'd' GROUP BY n
        ), weighed AS (
            SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
                   coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                   ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
            FROM worded LEFT JOIN summed USING (n) WHERE of = 'd'
        ), scored AS (
            SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) FILTER (n_words >= 20) OVER () AS able FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank
        FROM ranked
    """,
    "op13_conversation_trie": f"""
        WITH {CRC}, turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, {crc("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM turns), crc_table
        ), rebuilt AS (
            SELECT i.conv_id, 0 AS part, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 5 WHERE t.place < i.h
            UNION ALL
            SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id WHERE t.place >= i.h
        ), walks AS (
            SELECT i.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (r.place IS NOT NULL), []) AS walk
            FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id
        ), paths AS (
            SELECT conv_id, len(walk) AS n, unnest(range(len(walk) + 1)) AS depth, walk FROM walks
        ), prefixes AS (
            SELECT conv_id, n, depth, list_slice(walk, 1, depth) AS prefix FROM paths
        ), nodes AS (
            SELECT prefix, depth, min(conv_id) AS id, count(*) AS n_convs, coalesce(strlen(prefix[depth].text), 0) AS bytes,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY prefix, depth
        ), placed AS (
            SELECT p.conv_id, p.depth, id FROM prefixes p JOIN nodes USING (prefix, depth)
        ), hung AS (
            SELECT v.*, p.id AS parent FROM nodes v LEFT JOIN placed p ON p.conv_id = v.id AND p.depth = v.depth - 1
        ), family AS (
            SELECT parent AS id, depth - 1 AS depth, count(*) AS n_children FROM hung WHERE parent IS NOT NULL GROUP BY ALL
        ), below AS (
            SELECT p.id, p.depth, count(*) FILTER (f.n_children IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens
            FROM hung v LEFT JOIN family f ON f.id = v.id AND f.depth = v.depth
            JOIN placed p ON p.conv_id = v.id AND p.depth <= v.depth GROUP BY p.id, p.depth
        )
        SELECT v.id AS conv_id, v.depth::BIGINT AS depth, v.parent AS parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
               n_leaves, saved_tokens, ends_sha256
        FROM hung v JOIN below b ON b.id = v.id AND b.depth = v.depth LEFT JOIN family f ON f.id = v.id AND f.depth = v.depth
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line,
                   translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), frequent AS (
            SELECT key, max(doc_id) AS top_id FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT l.*, coalesce(l.doc_id <> f.top_id, false) AS lost FROM lines l LEFT JOIN frequent f USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_near_dedup,
        op3_fingerprints,
        op4_bpe,
        op5_toxicity,
        op6_quality,
        op7_best_fit_packing,
        op8_pii,
        op9_exact_dedup,
        op10_line_dedup,
        op11_simhash,
        op12_importance_resampling,
        op13_conversation_trie,
    )
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
