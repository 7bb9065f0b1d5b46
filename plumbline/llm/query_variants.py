"""op13: words of all documents that are spelling variants of others. Spark's crc32 decides which runs lose a character, which SQL has not."""

from plumbline.llm.variants import spelling_variants
from plumbline.runtime import table


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES: dict[str, str] = {}
