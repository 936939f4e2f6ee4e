"""The registered queries of this package, with production parameters over whole tables."""

import uuid

from pyspark.sql import functions as F

from reporank.llm.common import table
from reporank.llm.decontaminate import contamination
from reporank.llm.exact_dedup import exact_duplicates
from reporank.llm.hard_negatives import hard_negatives
from reporank.llm.lexical_search import ranked
from reporank.llm.line_dedup import repeated_lines
from reporank.llm.packing import pack
from reporank.llm.pseudonyms import pseudonyms
from reporank.llm.secret_scan import base_only, counted, judged, listed, scan
from reporank.llm.simhash import near_duplicates
from reporank.llm.suffix_dedup import without_repeats
from reporank.llm.token_counts import count_tokens
from reporank.llm.toxicity import severity, trained
from reporank.llm.vector_links import linked_vectors
from reporank.session import scratch_root


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, d):
    return pack(table(spark, d, "documents"), tokenizer_path())


def op2_exact_dedup(spark, d):
    return exact_duplicates(table(spark, d, "documents"))


def op3_token_counts(spark, d):
    """A cache of its own for each call, so that every distinct text is encoded in it."""
    cache = f"{scratch_root(spark)}/reporank-token-cache-{uuid.uuid4().hex}"
    return count_tokens(table(spark, d, "documents"), tokenizer_path(), cache)


def op4_simhash(spark, d):
    found = near_duplicates(table(spark, d, "documents"))
    hex_print = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select("doc_id", hex_print.alias("fingerprint"), "component_id")


def op5_pii(spark, d):
    """The key of a real run comes from a secret store; this one only has to be the same here."""
    return pseudonyms(table(spark, d, "documents"), key=b"check key")


def op6_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return severity(docs, trained(docs, table(spark, d, "labels")))


def op7_decontamination(spark, d):
    found = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "longest_item",
        "longest_at",
    )


def op8_line_dedup(spark, d):
    return repeated_lines(table(spark, d, "documents"))


def op9_suffix_dedup(spark, d):
    return without_repeats(table(spark, d, "documents"), with_text=False)


def op10_secret_scan(spark, d):
    spans = F.col("spans")
    return scan(table(spark, d, "documents")).select(
        "doc_id",
        *(counted(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(listed(base_only(spans)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        listed(base_only(spans), "verdict").alias("base_verdicts"),
        judged(base_only(spans), "copied").alias("n_copied"),
        judged(base_only(spans), "owned").alias("n_owned"),
    )


def op11_lexical_search(spark, d):
    return ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_embedding_dedup(spark, d):
    return linked_vectors(table(spark, d, "embeddings"))


def op13_hard_negatives(spark, d):
    """Every seventh label is moved by one, as the contract asks."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, d, "embeddings").withColumn("label", moved))


REGISTERED = {
    f.__name__: f
    for f in (
        op1_packing, op2_exact_dedup, op3_token_counts, op4_simhash, op5_pii, op6_toxicity,
        op7_decontamination, op8_line_dedup, op9_suffix_dedup, op10_secret_scan,
        op11_lexical_search, op12_embedding_dedup, op13_hard_negatives,
    )
}
