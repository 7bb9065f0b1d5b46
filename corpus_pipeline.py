"""A training-corpus pipeline of five operators over documents.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the token ids.
"""

from __future__ import annotations

import public_tokenizers

from plumbline.llm.mixing import repeat_documents
from plumbline.llm.sentencepiece_tokens import encode_sentencepiece
from plumbline.llm.simhash import keep_one
from plumbline.llm.substrings import strip_repeats
from plumbline.llm.toxicity import drop_toxic, fit
from plumbline.runtime import materialize, release, table


def toxicity(spark, docs, sf_dir):
    """Documents that the model, trained on labelled ones outside the held-out fold, calls toxic go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """Of each component of SimHash links the document with the smallest id stays."""
    return keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """Words that a window of 20 covers whose words also start earlier go."""
    return strip_repeats(docs)


def source_mix(spark, docs, sf_dir):
    """Documents come as often as their source's target says."""
    return repeat_documents(docs)


def token_ids(spark, docs, sf_dir):
    """SentencePiece ids of every text."""
    return encode_sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Similarity by hashes of shingles, learned scores and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
