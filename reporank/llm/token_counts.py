"""Token counts through a digest cache.

The cache is a Parquet table in a shared folder: content digest, tokenizer version, count.
Documents are joined to it by digest; the distinct texts without a count are encoded once
and appended. A retried or doubled append adds equal rows, which a read collapses.

Content is normalised only in ways that cannot change the tokens: null becomes empty. The
version is the digest of the tokenizer file and of the library's version.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; rows
without identifier are returned too; other columns are ignored; an empty table adds nothing.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.bpe import content_digest, word_ids
from reporank.session import exists, written

CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{content_digest(path)} {tokenizers.__version__}".encode()).hexdigest()


def piece_counter(path):
    """Counts of a sentencepiece model, by one call per batch."""
    from reporank.llm.common import worker_wide

    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    model = worker_wide("pieces_" + hashlib.md5(path.encode()).hexdigest(), load)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def counter(path):
    if path.endswith(".model"):
        return piece_counter(path)
    held = word_ids(path)
    return lambda texts: [len(held.ids(x)) // held.kind.itemsize for x in texts]


def _encoder(path, version):
    def count(batches):
        count_all = counter(path)
        for batch in batches:
            counts = count_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest"),
                    pa.array([version] * batch.num_rows, pa.string()),
                    pa.array(np.array(counts, dtype=np.int64)),
                ],
                ["digest", "version", "n_tokens"],
            )

    return count


def _stored(spark, cache, version):
    """Counts by digest; empty while nothing is stored."""
    there = exists(spark, cache)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    limit: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. New texts enter the cache."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    missing = distinct.join(_stored(spark, cache, version), "digest", "left_anti")
    missing.mapInArrow(_encoder(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    keyed = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counts = written(_stored(spark, cache, version))  # so that the join can split a digest many share
    return keyed.join(counts, "digest").select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
