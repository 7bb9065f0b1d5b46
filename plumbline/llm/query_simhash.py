"""op1: SimHash near-duplicates of all documents."""

from plumbline.llm.simhash import simhash_components
from plumbline.runtime import table


def op1_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
