"""Queries on documents: mixing, SimHash near-duplicates, decontamination, toxicity, repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, lines, mixing, simhash, toxicity
from cairn.llm.common import fold, table


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "hits")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_bitmaps(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(lines.kept_text(F.col("text"), F.col("runs")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_mixing": op2_mixing, "op3_simhash": op3_simhash, "op6_decontamination": op6_decontamination, "op9_toxicity": op9_toxicity, "op11_lines": op11_lines}

ORACLES = {
    "op2_mixing": r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rn - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM per),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w),
p AS (SELECT *, (total - cap_before) * weight >= cap * weight_left AS stops FROM o),
g AS (
  SELECT *, CAST(total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS DOUBLE) AS lft,
         CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS DOUBLE) AS free
  FROM p),
t AS (SELECT rn, source, source_size, CAST(total AS BIGINT) AS total, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE lft * weight / free END AS target FROM g),
b AS (SELECT greatest(1, least(4096, max(total) // 65536)) AS block, max(total) AS total FROM t),
c AS (SELECT rn, sum(target) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t WHERE target > 0),
e AS (SELECT rn, upto / max(upto) OVER () AS hi FROM c),
spans AS (SELECT rn, coalesce(lag(hi) OVER (ORDER BY rn), 0) AS lo, hi FROM e),
slots AS (SELECT i, i * CAST(0.6180339887498949 AS DOUBLE) - floor(i * CAST(0.6180339887498949 AS DOUBLE)) AS x
          FROM (SELECT unnest(range(1, total // block + 1)) AS i FROM b)),
r AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY i) - 1 AS rank FROM slots JOIN spans ON x >= lo AND x < hi),
placed AS (
  SELECT row_number() OVER () AS line, s.doc_id, s.size, t.rn, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.rn ORDER BY h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT line, rn, size, start + p * source_size AS pos FROM placed, range(3) AS q(p) WHERE size > 0),
pieces AS (
  SELECT line, rn, pos, size, block, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS rank FROM passes, b),
words AS (
  SELECT line, sum(least(pos + size, (pieces.rank + 1) * block) - greatest(pos, pieces.rank * block)) AS n
  FROM pieces JOIN r ON r.rn = pieces.rn AND r.rank = pieces.rank GROUP BY line)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) AS BIGINT) AS taken FROM placed LEFT JOIN words ON words.line = placed.line
""",
    "op11_lines": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
