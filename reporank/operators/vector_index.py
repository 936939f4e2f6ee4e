"""A stored inverted-file index for the nearest stored vector: cells, probing, re-ranking.

A folder holds ``centroids`` (the cells) and ``vectors``, one directory per cell. Cells come
from a documented sample: at most ``TRAINED`` vectors, clustered by direction. Every stored
vector lies in the directory of its closest centroid; rows that are stored later go there too,
without training again. A search reads the directories of the ``probes`` closest cells of
each incoming vector and no others (partition pruning), and compares exactly within them, so
what it returns is right, but a match in a cell that was not probed is missed. ``recall``
compares with the exact way, which stays the default of :func:`reporank.plans.search.search`.

``index_cells`` tells how evenly cells are filled: when a few hold most vectors, build anew.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.operators.nearest import (
    HIT, INCOMING_TILE, STORED_TILE, best_hits, nearest_stored, slim, tiled_hits, unit,
)
from reporank.schemas import VECTOR
from reporank.session import exists, written

TRAINED = 16384  # vectors that cells are learnt from, at most
CELLS, PROBES, ROUNDS = 64, 8, 12
FILE_ROWS = 200_000  # stored rows a file of a cell holds, about
MOST_CELLS = 4096  # one centroid each travels with every task


def _means(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Directions that vectors gather around (k-means on the sphere), from spread-out starts."""
    chosen = [0]
    away = 1 - vectors @ vectors[0]
    while len(chosen) < min(cells, len(vectors)) and away.max() > 1e-9:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, 1 - vectors @ vectors[chosen[-1]])
    means = vectors[chosen]
    for _ in range(ROUNDS):
        nearest = (vectors @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), means)
    return means


def _centroids(spark, folder) -> np.ndarray:
    rows = spark.read.schema("cell int, v array<double>").parquet(f"{folder}/centroids").orderBy("cell").collect()
    return np.array([r.v for r in rows])  # at most MOST_CELLS rows


def _closest(means, count):
    """Column function: the ``count`` closest cells of a vector, closest first."""
    dims = means.shape[1]

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        near = unit(vectors, dims) @ means.T
        best = np.argsort(-near, axis=1, kind="stable")[:, :count].astype(np.int32)
        offsets = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))

    return cells.asNondeterministic()


def append_index(stored: DataFrame, folder: str, job_id="job_id", vector="embedding"):
    """Store further vectors under the cells that are there; vectors without length are left out."""
    means = _centroids(stored.sparkSession, folder)
    rows = slim(stored, job_id, vector).filter(F.exists("v", lambda x: x != 0))
    housed = written(rows.withColumn("cell", F.get(_closest(means, 1)("v"), 0)))
    counts = {r.cell: -(-r["count"] // FILE_ROWS) for r in housed.groupBy("cell").count().collect()}
    if not counts:
        return
    # a cell's files are written by as many tasks as its rows need
    spread = F.element_at(F.array(*(F.lit(counts.get(c, 1)) for c in range(len(means)))), F.col("cell") + 1)
    partitions = int(housed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = housed.repartition(partitions, "cell", F.pmod(F.xxhash64("id"), spread))
    dealt.write.mode("append").partitionBy("cell").parquet(f"{folder}/vectors")


def build_index(
    stored: DataFrame, folder: str, cells: int = CELLS, sample: int = TRAINED, job_id="job_id", vector="embedding"
):
    """Learn cells from at most ``sample`` vectors, chosen by hash, and store all vectors."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells is 1 to {MOST_CELLS}")
    rows = slim(stored, job_id, vector).filter(F.exists("v", lambda x: x != 0))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not picked.num_rows:
        raise ValueError("an index needs vectors to learn its cells from")
    column = picked.column("v").combine_chunks()
    means = _means(unit(column, len(column[0])), cells)
    spark = stored.sparkSession
    table = [(i, v.tolist()) for i, v in enumerate(means)]
    spark.createDataFrame(table, "cell int, v array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    append_index(stored, folder, job_id, vector)


def stored_vectors(spark, folder: str) -> DataFrame:
    """``(id, v, cell)`` of the index; ``cell`` is the directory, so filters on it prune files."""
    if not exists(spark, f"{folder}/vectors"):
        return spark.createDataFrame([], "id string, v array<double>, cell int")
    schema = f"id string, v {VECTOR.simpleString()}, cell int"
    return spark.read.schema(schema).parquet(f"{folder}/vectors")


def index_cells(spark, folder: str) -> DataFrame:
    """``(cell, n)``: how many vectors every cell that has any holds."""
    return stored_vectors(spark, folder).groupBy("cell").agg(F.count("*").alias("n"))


def nearest_indexed(
    incoming: DataFrame,
    folder: str,
    query_id: str = "query_id",
    vector: str = "embedding",
    threshold: float = fixed.CACHE_SIMILARITY,
    probes: int = PROBES,
    allowed: DataFrame | None = None,
    job_type: str = "string",
) -> DataFrame:
    """``(query_id, job_id, similarity)`` like :func:`nearest_stored`, from the probed cells.

    ``allowed`` has the ``job_id`` that may be found (all without it). Job ids are stored as
    text; ``job_type`` is what they are returned as.
    """
    spark = incoming.sparkSession
    means = _centroids(spark, folder)
    dims = means.shape[1]
    asked = slim(incoming, query_id, vector).filter(F.exists("v", lambda x: x != 0))
    probing = written(asked.select("id", "v", F.explode(_closest(means, probes)("v")).alias("cell")))
    chunks = [1] * len(means)
    asked_cells = probing.groupBy("cell").count().collect()  # at most one row per cell
    for row in asked_cells:
        chunks[row["cell"]] = -(-row["count"] // INCOMING_TILE)
    probed = stored_vectors(spark, folder).filter(F.col("cell").isin([r["cell"] for r in asked_cells]))
    if allowed is not None:
        known = allowed.select(F.col("job_id").cast("string").alias("id"))
        probed = probed.join(known, "id", "left_semi")
    slices = [1] * len(means)
    for row in probed.groupBy("cell").count().collect():
        slices[row["cell"]] = -(-row["count"] // STORED_TILE)
    hits = tiled_hits(probed, probing, slices, chunks, dims, threshold) if asked_cells else spark.createDataFrame([], HIT)
    return best_hits(hits, query_id, incoming.schema[query_id].dataType, "job_id", job_type)


def recall(incoming: DataFrame, stored: DataFrame, folder: str, probes: int = PROBES, **options) -> DataFrame:
    """One row: queries with a match, how many the index answers with one as similar, and their share."""
    exact = nearest_stored(incoming, stored, **options).select("query_id", F.col("similarity").alias("exact"))
    found = nearest_indexed(incoming, folder, probes=probes, **options).select("query_id", "similarity")
    both = exact.join(found, "query_id", "left")
    same = F.count_if(F.col("similarity") >= F.col("exact") - 1e-9)
    return both.agg(F.count("*").alias("wanted"), same.alias("found")).select(
        "wanted", "found", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted")).alias("recall")
    )
