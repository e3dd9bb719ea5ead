"""Queries with models and indexes: top-k and ranked lexical search, main text of pages, language-model scores, whitened embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import html, lm, ranked, search, whitening
from cairn.llm.common import cut, table


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, whole, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where(F.pmod("doc_id", F.lit(20)) == 0))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(whitening.grid(table(spark, sf_dir, "embeddings")).select("vec_id", "x"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES = {"op4_search": op4_search, "op8_html": op8_html, "op10_lm": op10_lm, "op12_ranked": op12_ranked, "op13_whitening": op13_whitening}

ORACLES = {
    "op12_ranked": r"""
WITH d AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
size AS (SELECT line, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
tf AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(t) AS term FROM d) GROUP BY line, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, line, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN size USING (line), totals GROUP BY item_id, line),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
  FROM s JOIN size USING (line) WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
""",
}
