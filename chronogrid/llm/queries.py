"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import (
    decontaminate,
    html_crf,
    imatch,
    language_id,
    line_dedup,
    packing,
    personal_data,
    prefix_trie,
    quality,
    simhash,
    url_filter,
    warc,
    whitening,
)
from chronogrid.llm.common import held_out, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "_lines.n_lines",
        "_lines.n_kept",
        "_lines.n_exact",
        "_lines.n_near",
        "_lines.first_docs",
        F.sha2("text", 256).alias("text_sha256"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = quality.score(docs, quality.train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.train(pages))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(packing.pack(table(spark, sf_dir, "documents")), "sequences").drop("ids")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_line_dedup,
        op3_imatch,
        op4_quality,
        op5_decontamination,
        op6_warc,
        op7_simhash,
        op8_html_extraction,
        op9_packing,
        op10_url_filter,
        op11_personal_data,
        op12_prefix_trie,
        op13_embedding_whitening,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS run, len(list_slice(w, i, i + 9)) AS n FROM cut),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, s.n, item FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run FROM starts) s
  JOIN wins USING (run)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM f""",
    "op12_prefix_trie": """WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  length(coalesce(role, '')) || '/' || coalesce(role, '') || '/' || coalesce(text, '') AS e, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM o),
steps AS (SELECT c, unnest(range(1, length(CAST(c AS VARCHAR)) + 1)) AS i FROM ids),
digits AS (SELECT c, list_concat([4294967295::BIGINT], flatten(list([ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] ORDER BY i))) AS l FROM steps GROUP BY c),
hs AS (SELECT c, xor(list_reduce(l, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h FROM digits),
t AS (SELECT hs.c, o.pos AS part, 0 AS own, e, size FROM hs JOIN o ON o.c = hs.c - hs.c % 5 AND o.pos <= h
  UNION ALL SELECT hs.c, o.pos, 1, e, size FROM hs JOIN o ON o.c = hs.c AND o.pos > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, part) AS pos, e, size FROM t),
whole AS (SELECT c, list(e ORDER BY pos) AS es, list(size ORDER BY pos) AS sizes FROM r GROUP BY c),
m AS (SELECT c, pos AS d, list_slice(es, 1, pos) AS p, sizes[pos] AS size, len(es) = pos AS ends FROM (SELECT c, es, sizes, unnest(range(1, len(es) + 1)) AS pos FROM whole)
  UNION ALL SELECT ids.c, 0, [], 0, whole.c IS NULL FROM ids LEFT JOIN whole ON whole.c = ids.c),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM m GROUP BY p, d),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS b WHERE b.d = n.d + 1 AND list_slice(b.p, 1, n.d) = n.p) AS n_children
  FROM n LEFT JOIN n AS u ON n.d > 0 AND u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)),
s AS (SELECT a.p, a.d, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM k AS a JOIN k AS b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p GROUP BY a.p, a.d)
SELECT conv_id, k.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM k JOIN s ON k.p = s.p AND k.d = s.d""",
}
