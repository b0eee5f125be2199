"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.llm.decontaminate import contaminated
from mediacast.llm.embedding_forest import near_vectors
from mediacast.llm.filter_audit import audit
from mediacast.llm.language import languages
from mediacast.llm.mixing import mixed
from mediacast.llm.ngram_join import near_duplicates
from mediacast.llm.packing import packed
from mediacast.llm.quality_rules import quality
from mediacast.llm.secrets import secrets
from mediacast.llm.token_counts import token_counts
from mediacast.llm.url_filter import judged
from mediacast.llm.warc import archived
from mediacast.llm.whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_table(spark, folder, "documents")).withColumn("target", F.round("target", 4))


def op4_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archived(_table(spark, folder, "pages"), f"warc-{uuid.uuid4().hex}")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(_table(spark, folder, "documents"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(_table(spark, folder, "documents"))


def op11_length_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(_table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_ngram_jaccard,
            op3_source_mix,
            op4_warc_archive,
            op5_language_id,
            op6_url_filter,
            op7_embedding_forest,
            op8_quality_rules,
            op9_benchmark_decontamination,
            op10_secret_scan,
            op11_length_packing,
            op12_filter_audit,
            op13_whitening,
        )
    }


_NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * overlap >= 80 * (x.n + y.n - overlap)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""

_SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS label FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, number, source_size,
         least(most, coalesce((SELECT level FROM l WHERE level <= most / weight ORDER BY most / weight, number LIMIT 1), 0) * weight) AS target
  FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY t.number ORDER BY label, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 4) AS target,
       (greatest(least(start + size, goal) - least(start, goal), 0)
        + greatest(least(start + source_size + size, goal) - least(start + source_size, goal), 0))::BIGINT AS taken
FROM p
"""

_WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


_URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
  AS t(h, pre, verdict)
), f AS (
  SELECT p.*, (SELECT arg_max({'rule': h || pre, 'verdict': verdict}, length(h || pre)) FROM rules
               WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS r FROM p
), t AS (
  SELECT *, regexp_replace(path, '[0-9]+', '*', 'g') AS template FROM f
), c AS (
  SELECT host, template, count(r) AS labelled, count(CASE WHEN r.verdict = 'block' THEN 1 END) AS blocked FROM t GROUP BY ALL
)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN (blocked + 1.0) / (labelled + 2.0) >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN c USING (host, template)
"""

_EMBEDDING_FOREST = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached
), c AS (SELECT node AS vec_id, min(reached) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


_FILTER_AUDIT = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals
  FROM documents
), f AS (
  SELECT d.doc_id, part,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * capitals > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM d
), c AS (
  SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || letter FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5
), j AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, docs, good, toxic,
         fails[ascii(substr(filter_order, step, 1)) - 64] AS failing,
         fails[1]::INT + fails[2]::INT + fails[3]::INT + fails[4]::INT + fails[5]::INT AS failed,
         least(CASE WHEN fails[1] THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN fails[2] THEN instr(filter_order, 'B') ELSE 6 END,
               CASE WHEN fails[3] THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN fails[4] THEN instr(filter_order, 'D') ELSE 6 END,
               CASE WHEN fails[5] THEN instr(filter_order, 'E') ELSE 6 END) AS leaves_at
  FROM c, s
), m AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(docs) FILTER (leaves_at > step), 0)::BIGINT AS kept,
         coalesce(sum(docs) FILTER (leaves_at = step), 0)::BIGINT AS removed,
         coalesce(sum(docs) FILTER (failing AND leaves_at < step), 0)::BIGINT AS redundant,
         coalesce(sum(docs) FILTER (failing AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (leaves_at = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (leaves_at = step), 0)::BIGINT AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM m
"""


def statements() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": _NGRAM_JACCARD,
        "op3_source_mix": _SOURCE_MIX,
        "op4_warc_archive": _WARC,
        "op6_url_filter": _URL_FILTER,
        "op7_embedding_forest": _EMBEDDING_FOREST,
        "op12_filter_audit": _FILTER_AUDIT,
    }
