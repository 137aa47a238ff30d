"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bin_packing, class_lm, decontamination, fertility, fill_in_middle, license_scan, near_duplicates,
               pii_surrogates, prefix_trie, token_counts, token_output, toxicity, warc)
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PII_KEY = "surrogate-key-1"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(spark, table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.train(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"), PIECE_BPE)


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm_scores(table(spark, sf_dir, "documents"), class_lm.by_crc(F.col("doc_id")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, "n_entities")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_pages(spark, table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_decontamination, op3_toxicity, op4_fertility, op5_bin_packing, op6_class_lm,
    op7_near_duplicates, op8_license_scan, op9_pii_surrogates, op10_token_counts, op11_prefix_trie, op12_warc,
    op13_fill_in_middle)}

# CRC-32 is folded byte by byte; a path is the turns' SHA-256 digests one after the other.
OP11_SQL = """
WITH o AS (SELECT conv_id, coalesce(text, '') AS t,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                     lambda p, r: xor(p >> 1, (p & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)::BIGINT % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, c.h, least(c.h, (SELECT count(*) FROM o WHERE o.conv_id = c.conv_id - c.conv_id % 100)) AS k FROM c),
r AS (SELECT b.conv_id, o.pos AS q, o.t, o.dg FROM b JOIN o ON o.conv_id = b.conv_id - b.conv_id % 100 AND o.pos < b.h
      UNION ALL SELECT b.conv_id, o.pos - b.h + b.k, o.t, o.dg FROM b JOIN o ON o.conv_id = b.conv_id AND o.pos >= b.h),
p AS (SELECT conv_id, q + 1 AS depth, length(t) AS chars, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY q) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY path),
k AS (SELECT path[1:64 * (depth - 1)] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT path, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS last FROM p) WHERE last = 1 GROUP BY path),
s AS (SELECT x.path[1:64 * x.up] AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves
      FROM (SELECT n.path, unnest(range(n.depth + 1)) AS up, (n_convs - 1) * chars AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
            FROM n LEFT JOIN k USING (path)) x GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:64 * (n.depth - 1)]"""

# Base32 from the hexadecimal digest: five digits are four characters.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT, 1)), '') AS payload_digest,
             row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place,
             max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN original END AS refers_to
FROM d"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units,
             ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

ORACLE: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
