"""The registered queries of the operators and their SQL, where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import exact_dedup, language, mixing, near_dedup, pieces, pii, quality, secrets, toxicity, warc
from chronofold.llm.common import documents


#: The tokenizer model; read on the driver only.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    # A gap in archives just written means that pages are missing.
    whole = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.col("archive"), F.col("offset"), F.col("reason"))))
    return found.filter(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), TOKENIZER)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_minhash_near_dedup, op3_language_id, op4_pii, op5_warc, op6_toxicity, op7_exact_dedup, op8_sentencepiece, op9_secrets, op10_quality_rules)}


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


#: Every pair of documents that share a shingle, then everything reachable; for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

_BOILER = "|".join(quality.BOILERPLATE)
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
e AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS uses FROM e),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM a, (SELECT unnest([0, 1, 2]) AS k) WHERE uses > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
lm AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, length(line) - length(replace(line, '|', '')) AS bars,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols FROM ln),
lb AS (SELECT *, words > 0 AND ((bars >= {quality.NAV_BARS} AND bars * 4 >= words) OR symbols * 2 > words
         OR (words <= {quality.BOILER_WORDS} AND regexp_matches(line, '(?i){_BOILER}'))
         OR (words < {quality.SHORT_WORDS} AND NOT regexp_matches(rtrim(line), '[.!?:;,…»"''”’)\]。！？]\s*$'))) AS bad FROM lm),
l AS (SELECT doc_id, sum(length(line)) AS whole, coalesce(sum(length(line)) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS n_bad_lines,
        count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines FROM lb GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines, lost::BIGINT AS lost_chars, whole
      FROM w JOIN l USING (doc_id) LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars * 100 <= whole * {quality.MAX_LOST_PERCENT} AS kept, n_bad_lines, lost_chars FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_quality_rules": OP10_SQL}
