"""Nearest stored vector with a similarity of at least a cut-off, exactly.

Two ways, same rows. Few incoming vectors: every task scores its stored rows
against all of them and keeps the best per incoming vector. Too many to ship to
every task: both sides are cut into tiles around pivot vectors, and a tile is
left out only where the triangle inequality rules out any match in it.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.vectors import as_matrix
from reporank.schemas import VECTOR
from reporank.session import written

BROADCAST_BYTES = 64 << 20  # most incoming vectors that are shipped to every task
PIVOTS = 64
STORED_TILE = 50_000  # stored vectors one task holds at a time
INCOMING_TILE = 500_000  # incoming vectors streamed past one stored tile
DIGITS = 12  # similarities that differ by less are a tie
JOINED = 0.5  # share of all cells that are probed above which cells are put together
BLOCK = 1024  # incoming vectors per matrix product
STORED_BLOCK = 2048  # stored vectors per matrix product (16 MB)
HIT = "query_id string, job_id string, similarity double"


def unit(vectors, dims):
    matrix = as_matrix(vectors, dims)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size != 0)


def _hits(incoming_ids, incoming, stored_ids, stored, threshold):
    """Record batches with the best stored id of each incoming vector that has a close one."""
    order = np.argsort(stored_ids, kind="stable")  # the first of a tie is the smallest id
    rough_incoming, rough_stored = incoming.astype(np.float32), stored.astype(np.float32)
    least = threshold - 1e-11 - (incoming.shape[1] + 4) * 2.0**-22  # what single precision may be off
    for start in range(0, len(incoming), BLOCK) if len(stored) else ():
        part, rough = incoming[start : start + BLOCK], rough_incoming[start : start + BLOCK]
        best, at = np.full(len(part), -np.inf), np.zeros(len(part), np.int64)
        for first in range(0, len(order), STORED_BLOCK):
            block = order[first : first + STORED_BLOCK]
            close = np.flatnonzero((rough @ rough_stored[block].T).max(axis=1) >= least)
            if not len(close):
                continue
            sims = np.round(part[close] @ stored[block].T, DIGITS)
            near = sims.argmax(axis=1)
            sim = sims[np.arange(len(near)), near]
            closer = sim > best[close]
            best[close[closer]], at[close[closer]] = sim[closer], block[near[closer]]
        row = np.flatnonzero(best >= threshold)
        if len(row):
            columns = [incoming_ids[start + row], stored_ids[at[row]], best[row]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["query_id", "job_id", "similarity"]
            )


def strings(column):
    return column.to_numpy(zero_copy_only=False).astype(object)


def slim(df, key, vector):
    """String id and vector of the rows that have one."""
    return df.filter(F.size(vector) > 0).select(
        F.col(key).cast("string").alias("id"), F.col(vector).cast(VECTOR).alias("v")
    )


def _by_broadcast(table, stored, dims, threshold):
    spark = stored.sparkSession
    ids, matrix = strings(table.column("id")), unit(table.column("v").combine_chunks(), dims)
    shipped = spark.sparkContext.broadcast((ids, matrix))

    def score(batches):
        ids, matrix = shipped.value
        for b in batches:
            yield from _hits(ids, matrix, strings(b.column(0)), unit(b.column(1), dims), threshold)

    return stored.mapInArrow(score, HIT)


def _bins(many):
    """Number of the bin of each cell: cells in a row that hold ``STORED_TILE`` vectors at most together, if several."""
    bins, held = [], 0
    for n in many.tolist():
        new = bool(bins) and held + n > STORED_TILE
        held = n if new else held + n
        bins.append(bins[-1] + new if bins else 0)
    return bins


def _by_tiles(incoming, stored, dims, threshold):
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6  # distance of unit vectors at the cut-off
    picked = stored.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").toArrow()
    if not picked.num_rows:
        return stored.sparkSession.createDataFrame([], HIT)
    pivots = unit(picked.column("v").combine_chunks(), dims)

    def distances(vectors):
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(unit(vectors, dims) @ pivots.T, -1, 1)))

    @F.arrow_udf("struct<cell:int,distance:double>")
    def home(vectors: pa.Array) -> pa.Array:
        away = distances(vectors)
        cell = away.argmin(axis=1)
        nearest = away[np.arange(len(cell)), cell]
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(nearest)], ["cell", "distance"]
        )

    housed = stored.withColumn("home", home("v")).select("id", "v", "home.*")
    held = housed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    radius, slices = np.full(len(pivots), -np.inf), [1] * len(pivots)
    many = np.zeros(len(pivots), np.int64)
    for row in held.collect():  # at most one row per pivot
        radius[row.cell], slices[row.cell], many[row.cell] = row.far, -(-row.n // STORED_TILE), row.n

    @F.arrow_udf("array<int>")
    def probes(vectors: pa.Array) -> pa.Array:
        away = distances(vectors)
        near = (away <= radius + reach) & (away <= away.min(axis=1, keepdims=True) + 2 * reach)
        offsets = np.concatenate(([0], np.cumsum(near.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(near)[1].astype(np.int32)))

    probing = incoming.select("id", "v", F.explode(probes("v")).alias("cell"))
    counts = [0] * len(pivots)
    for row in probing.groupBy("cell").count().collect():  # at most one row per pivot
        counts[row["cell"]] = row["count"]
    total = incoming.count()
    if sum(counts) > total * np.count_nonzero(many) * JOINED:
        # nearly nothing is ruled out: incoming vectors are copied for few large tiles, not for every cell
        bins = _bins(many)
        tiles = max(bins) + 1
        lookup = F.element_at(F.array(*map(F.lit, bins)), F.col("cell") + 1)
        whole = [max(1, -(-int(many[np.array(bins) == b].sum()) // STORED_TILE)) for b in range(tiles)]
        each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("cell")
        housed, probing = housed.withColumn("cell", lookup), incoming.select("id", "v", each)
        return tiled_hits(housed, probing, whole, [max(1, -(-total // INCOMING_TILE))] * tiles, dims, threshold)
    chunks = [max(1, -(-count // INCOMING_TILE)) for count in counts]
    return tiled_hits(housed, probing, slices, chunks, dims, threshold)


def tiled_hits(housed, probing, slices, chunks, dims, threshold):
    """Hits of ``probing`` (id, v, cell) among ``housed`` (id, v, cell) of the same cell.

    Every cell's stored rows are cut into ``slices[cell]`` parts and its incoming ones into
    ``chunks[cell]``; each pair of parts is a tile, and a task holds one stored part.
    """

    def per_cell(numbers):
        return F.element_at(F.array(*map(F.lit, numbers)), F.col("cell") + 1)

    def part_of(count):
        return F.pmod(F.xxhash64("id"), count.cast("long"))

    def every(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))

    tile = F.concat_ws("/", "cell", "slice", "chunk").alias("tile")
    left = (
        housed.withColumn("slice", part_of(per_cell(slices)))
        .withColumn("chunk", every(per_cell(chunks)))
        .select(tile, F.lit(0).alias("side"), "id", "v")
    )
    right = (
        probing.withColumn("chunk", part_of(per_cell(chunks)))
        .withColumn("slice", every(per_cell(slices)))
        .select(tile, F.lit(1).alias("side"), "id", "v")
    )

    def match(batches):
        current, ids, parts = None, [], []
        for batch in batches:
            tiles, sides = strings(batch.column(0)), batch.column(1).to_numpy()
            names, matrix = strings(batch.column(2)), unit(batch.column(3), dims)
            change = (tiles[1:] != tiles[:-1]) | (sides[1:] != sides[:-1])
            edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(tiles)]))
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if tiles[a] != current:
                    current, ids, parts = tiles[a], [], []
                if sides[a] == 0:
                    ids.append(names[a:b])
                    parts.append(matrix[a:b])
                elif parts:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                    yield from _hits(names[a:b], matrix[a:b], ids[0], parts[0], threshold)

    return (
        left.unionByName(right)
        .repartition("tile")
        .sortWithinPartitions("tile", "side")
        .mapInArrow(match, HIT)
    )


def best_hits(hits: DataFrame, query_id, query_type, job_id, job_type) -> DataFrame:
    """The most similar stored vector of each query, the smaller job id of a tie."""
    best = F.min(F.struct((-F.col("similarity")).alias("far"), F.col("job_id"))).alias("best")
    return (
        hits.groupBy("query_id")
        .agg(best)
        .select(
            F.col("query_id").cast(query_type).alias(query_id),
            F.col("best.job_id").cast(job_type).alias(job_id),
            (-F.col("best.far")).alias("similarity"),
        )
    )


def nearest_stored(
    incoming: DataFrame,
    stored: DataFrame,
    query_id: str = "query_id",
    job_id: str = "job_id",
    vector: str = "embedding",
    threshold: float = fixed.CACHE_SIMILARITY,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(query_id, job_id, similarity)`` for incoming vectors with a close stored one.

    Exact: the most similar stored vector, equal similarity broken by job id
    (as text), kept when the cosine is at least ``threshold``. Vectors that are
    null or empty match nothing.
    """
    asked, held = slim(incoming, query_id, vector), slim(stored, job_id, vector)
    head = asked.select(F.size("v").alias("n")).first()
    if head is None:
        hits = asked.sparkSession.createDataFrame([], HIT)
    else:
        room = max(1, broadcast_bytes // (8 * head.n))
        table = asked.limit(room + 1).toArrow()
        if table.num_rows <= room:
            hits = _by_broadcast(table, held, head.n, threshold)
        else:
            hits = _by_tiles(written(asked), held, head.n, threshold)
    kinds = incoming.schema[query_id].dataType, stored.schema[job_id].dataType
    return best_hits(hits, query_id, kinds[0], job_id, kinds[1])
