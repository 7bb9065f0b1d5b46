"""op12: language of all documents, learned from those outside the held-out fold. A learned score is beyond SQL."""

from pyspark.sql import functions as F

from plumbline.llm.language import fit, fold, identify
from plumbline.runtime import table

HELD_OUT = 2


def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs, held_out=HELD_OUT))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op12_language_id": op12_language_id}
ORACLES: dict[str, str] = {}
