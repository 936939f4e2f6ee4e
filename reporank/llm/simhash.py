"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into `BLOCKS` blocks. Two fingerprints that differ in at most
`DISTANCE` bits agree in at least BLOCKS - DISTANCE whole blocks, so they share a key made
of that many blocks. Keys join fingerprints, Hamming distance verifies, and the linked
fingerprints' connected components are the groups. Equal fingerprints are one row from the
start, so copies cost nothing.

A key with more than `PAIRED` different fingerprints is not paired up. Its fingerprints are
joined on the values in the middle instead: two fingerprints differ in at most two bits
exactly if some value is at most one bit away from both. That is 65 rows per fingerprint
and links everybody near a value to the smallest there, so the work stays linear, and what
is linked is exactly what pairs would have linked.

Defined cases: null text is empty text; a text without words has fingerprint zero and is
linked like any other; repeated rows get the same answer; rows without identifier are
returned and never name a component that has one; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reporank.operators.components import connected_components
from reporank.session import written

BLOCKS, DISTANCE, PAIRED = 5, 2, 16
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash over shingles of `width` words, repeats included."""
    own = (text or "").encode().lower().split()  # lower-cases A-Z, splits at ASCII white space
    if not own:
        return 0
    shingles = zip(*(own[i:] for i in range(width))) if len(own) >= width else [own]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        octets = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column="doc_id", text_column="text", width=3) -> DataFrame:
    """(doc_id, print) of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def hashed(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"]
            )

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed masks of all choices of blocks - distance blocks of 64 bits."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _middles(prints):
    """Links of fingerprints within two bits of each other, to the smallest around a value."""
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    around = prints.select(
        "print", F.explode(F.array(*(F.col("print").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("middle")
    )
    least = around.groupBy("middle").agg(F.min("print").alias("least"), F.max("print").alias("most"))
    near = around.join(least.filter("least < most").select("middle", "least"), "middle")
    return near.filter("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b")).distinct()


def links(prints: DataFrame, blocks: int = BLOCKS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at most `DISTANCE` bits apart.

    `prints` holds different fingerprints in the column `print`.
    """
    keys = F.array(
        *(
            F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key"))
            for i, m in enumerate(block_masks(blocks, DISTANCE))
        )
    )
    keyed = prints.select("print", F.inline(keys))
    # written, so that the join below can split a key that very many share
    shared = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = written(keyed.join(shared, ["t", "key"]))
    few = members.filter(F.col("n") <= paired)
    a, b = few.select("t", "key", F.col("print").alias("a")), few.select("t", "key", F.col("print").alias("b"))
    pairs = a.join(b, ["t", "key"]).filter("a > b AND bit_count(a ^ b) <= " + str(DISTANCE))
    many = members.filter(F.col("n") > paired).select("print").distinct()
    return pairs.select("a", "b").distinct().unionByName(_middles(many))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, blocks: int = BLOCKS
) -> DataFrame:
    """doc_id, print (signed), component_id: the smallest doc_id reachable over links."""
    rows = written(fingerprints(docs, id_column, text_column, width))
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(prints.select("print"), blocks), "a", "b")
    group = F.coalesce("component", "print").alias("component")
    grouped = prints.join(found, prints.print == found.node, "left").select("print", "first", group)
    named = written(grouped.groupBy("component").agg(F.min("first").alias("component_id")))
    by_print = grouped.select("print", "component").join(named, "component").select("print", "component_id")
    return rows.join(by_print, "print").select(F.col("doc_id").alias(id_column), "print", "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one document of each group: the smallest identifier.

    Rows are matched by identifier and fingerprint, so a hot fingerprint is no hot key.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    named = F.col(id_column).eqNullSafe(F.col("component_id"))
    keep = found.filter(named).select(F.col(id_column).alias("_keep"), F.col("print").alias("_print")).distinct()
    width, at = options.get("width", 3), docs.columns.index(text_column)

    def add(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), width) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, "_own"])

    own = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("_own", LongType())]))
    same = own[id_column].eqNullSafe(keep["_keep"]) & (own["_own"] == keep["_print"])
    return own.join(keep, same, "left_semi").select(*docs.columns)
