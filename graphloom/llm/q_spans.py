"""Problem 10: long exact spans shared between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.spans import long_shared, sharing, without_repeats
from graphloom.session import table


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return long_shared(table(spark, sf, "documents"), "doc_id", "text")[0].select("doc_id")


def p10_sharing(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, bytes in all, shared, and removable as non-first copies."""
    docs = table(spark, sf, "documents")
    found, spans = long_shared(docs, "doc_id", "text")
    return sharing(docs, "doc_id", spans.join(found, "doc_id", "left_semi"))


def p10_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the sentences of non-first shared stretches."""
    docs = table(spark, sf, "documents")
    found, spans = long_shared(docs, "doc_id", "text")
    return without_repeats(docs, "doc_id", spans.join(found, "doc_id", "left_semi"))


QUERIES = {f.__name__: f for f in (p10_found, p10_sharing, p10_deduplicated)}

ORACLE = {
    # every window of 400 characters, compared as it is
    "p10_found": """WITH w AS (
  SELECT doc_id, md5(substr(text, s, 400)) AS h FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS s FROM documents WHERE length(text) >= 400)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))
SELECT DISTINCT doc_id FROM w JOIN g USING (h)""",
    # shared windows of 400 characters, put together to stretches and measured in bytes
    "p10_sharing": """WITH w AS (
  SELECT doc_id, s, md5(substr(text, s, 400)) AS h FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS s FROM documents WHERE length(text) >= 400)),
g AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, s, first_doc < doc_id AS later FROM w JOIN g USING (h)),
k AS (SELECT 'shared' AS kind, doc_id, s FROM x UNION ALL SELECT 'later', doc_id, s FROM x WHERE later),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, doc_id ORDER BY s) AS island FROM (
  SELECT *, (s - coalesce(lag(s) OVER (PARTITION BY kind, doc_id ORDER BY s), -1000) > 400)::INT AS fresh FROM k)),
st AS (SELECT kind, doc_id, island, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY ALL),
n AS (SELECT doc_id, kind, sum(strlen(substr(text, a, b - a)))::BIGINT AS n FROM st JOIN documents USING (doc_id) GROUP BY ALL)
SELECT d.doc_id, coalesce(strlen(d.text), 0)::BIGINT AS n_bytes, coalesce(y.n, 0)::BIGINT AS shared_bytes, coalesce(z.n, 0)::BIGINT AS removable_bytes
FROM documents d LEFT JOIN n y ON y.doc_id = d.doc_id AND y.kind = 'shared' LEFT JOIN n z ON z.doc_id = d.doc_id AND z.kind = 'later'""",
}
