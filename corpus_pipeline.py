"""Cleans `documents` stage by stage and packs what is left; each stage is one operator.

The last stage returns pieces of packed sequences, the others documents with all columns.
"""

from pyspark.sql import functions as F

from reporank.llm.common import table
from reporank.llm.decontaminate import decontaminated
from reporank.llm.line_dedup import without_repeated_lines
from reporank.llm.packing import pack
from reporank.llm.queries import tokenizer_path
from reporank.llm.simhash import without_near_duplicates
from reporank.llm.toxicity import trained, without_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that are rejected go."""
    return without_toxic(docs, trained(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark, docs, sf_dir):
    """Repeated lines go, documents stay; n_chars is that of the new text."""
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return without_repeated_lines(docs).withColumn("n_chars", length)


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays; fingerprints of three-word shingles link at two bits or fewer."""
    return without_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents in which a window of the benchmark occurs go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: MinHash, XXH64 and the fitted model are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
