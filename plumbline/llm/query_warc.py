"""op4: all pages archived, normalised and read back."""

from plumbline.llm.warc import archive_pages, read_archives
from plumbline.runtime import table


def op4_warc(spark, sf_dir):
    manifest = archive_pages(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}

ORACLES = {
    "op4_warc": """
WITH bytes AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
digits AS (
  SELECT page_id, h, strlen(h) AS payload_bytes, upper(sha1(h)) AS s,
         max(page_id) OVER (PARTITION BY h) AS keep
  FROM bytes),
bits AS (
  SELECT page_id, payload_bytes, keep, list_transform(range(160), lambda i:
           ((strpos('0123456789ABCDEF', s[i // 4 + 1]) - 1) >> (3 - CAST(i AS INT) % 4)) & 1) AS b
  FROM digits)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(
         b[5 * k + 1] * 16 + b[5 * k + 2] * 8 + b[5 * k + 3] * 4 + b[5 * k + 4] * 2 + b[5 * k + 5] + 1 AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM bits
"""
}
