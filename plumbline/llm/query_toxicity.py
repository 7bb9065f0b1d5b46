"""op2: toxicity of all documents, learned from the labels outside the held-out fold."""

from pyspark.sql import functions as F

from plumbline.llm.toxicity import fit, held_out, score
from plumbline.runtime import table


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
