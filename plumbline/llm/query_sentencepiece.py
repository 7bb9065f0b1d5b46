"""op5: all documents' SentencePiece ids, with parity and round trip."""

import public_tokenizers

from plumbline.llm.sentencepiece_tokens import encode_sentencepiece
from plumbline.runtime import table


def op5_sentencepiece(spark, sf_dir):
    return encode_sentencepiece(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
