"""op7: all documents mixed to the sources' target weights."""

from plumbline.llm.mixing import mix
from plumbline.runtime import table


def op7_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}

ORACLES = {
    "op7_mix_sources": r"""
WITH sizes AS (
  SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3 AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sums),
filled AS (
  SELECT *, row_number() OVER w AS nth, CAST(CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) AS DOUBLE)
            / CAST(CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS DOUBLE) AS level
  FROM weighed
  WINDOW w AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, nth) FILTER (WHERE weight * level <= cap) AS level FROM filled),
targets AS (
  SELECT source, source_size, least(weight * final.level, CAST(cap AS DOUBLE)) AS target FROM weighed, final),
parts AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS whole,
         CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM ordered
"""
}
