"""op9: all documents stored as PNG images, read back and described."""

from pyspark.sql import functions as F

from plumbline.llm.media import media_features, to_media
from plumbline.runtime import materialize, table


def op9_media_png(spark, sf_dir):
    stored = materialize(to_media(table(spark, sf_dir, "documents"), level=1), "media")
    out = media_features(stored)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature")
    )


QUERIES = {"op9_media_png": op9_media_png}
ORACLES: dict[str, str] = {}
