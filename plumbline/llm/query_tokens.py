"""op10: all documents' token ids in Simple-8b files, read back."""

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm.token_file import token_index, write_token_files
from plumbline.runtime import table

END_ID = 1


def op10_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_index(manifest, docs.schema["doc_id"].dataType.simpleString()).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
