"""Best rows of a pool for each of very many jobs that share it.

Jobs of one pool have the same candidates, so what does not depend on the job is worked out
once per pool. What does, the cosine, is a matrix product per tile: a slice of a pool's rows
against a chunk of its jobs. Jobs times rows are never listed: per job and slice a task passes
on only rows whose unrounded score is near enough to its best ``k`` to be among them, and those
are ranked exactly.
"""

import numpy as np
import pyarrow as pa
from pyarrow.compute import take
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.vectors import as_matrix
from reporank.schemas import VECTOR

SLICE = 1 << 16  # rows of a pool that one task holds, about
CHUNK = 1 << 16  # jobs streamed past one slice, about
BLOCK = 64  # jobs that are scored together
STEP = 1 << 11  # rows they are scored against at a time
PASSED = 1 << 14  # rows handed on at a time, about
# the relevance is rounded, weighted, and the sum rounded again; two scores differ by twice that
MARGIN = 4 * 10.0**-fixed.SCORE_DECIMALS
NEAR = "job_id string, no long, full_name string, quality_score double, health_score double, cosine double"


def _vectors(column):
    """Matrix and lengths of a list column, and which rows have a vector; null ones are zero."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    present = column.drop_null()
    dims = len(present[0]) if len(present) else 0
    matrix = np.zeros((len(column), dims))
    if len(present):
        matrix[known] = as_matrix(present, dims)
    return matrix, np.linalg.norm(matrix, axis=1), known


def _cosines(a, b, sizes):
    """Row by row, as :func:`reporank.functions.vectors.cosine_rows` has them."""
    dots = np.einsum("ij,ij->i", a, b)
    return np.divide(dots, sizes, out=np.zeros(len(dots)), where=sizes != 0)


def _units(matrix, lengths):
    return np.divide(matrix, lengths[:, None], out=np.zeros_like(matrix), where=lengths[:, None] != 0)


def _candidates(asked, rows, k, margin):
    """``(x, y)``: the rows ``y`` whose product with ``asked[x]`` is within ``margin`` of its best ``k``.

    The best ``k`` so far tell what of the next rows can be left out, so few rows are ever sorted.
    """
    least = np.full(len(asked), -np.inf, dtype=np.float32)
    found, room = [], 0
    for first in range(0, len(rows), STEP):
        score = asked @ rows[first : first + STEP].T
        if not first and score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        x, y = np.divmod(np.flatnonzero(score >= (least - margin)[:, None]), score.shape[1])
        found.append((x, y + first, score[x, y]))
        if sum(len(part[0]) for part in found) > room or first + STEP >= len(rows):
            x, y, s = map(np.concatenate, zip(*found))
            order = np.lexsort((-s, x))
            x, y, s = x[order], y[order], s[order]
            begin = np.searchsorted(x, np.arange(len(asked) + 1))
            enough = np.flatnonzero(np.diff(begin) >= k)
            least[enough] = np.maximum(least[enough], s[begin[enough] + k - 1])
            kept = s >= (least - margin)[x]
            found = [(x[kept], y[kept], s[kept])]
            room = 2 * len(found[0][0]) + k * len(asked)
    return found[0][:2] if found else (np.empty(0, np.int64),) * 2


def _near(jobs, vectors, held, k):
    """Record batches of the rows in ``held`` that may be among the best ``k`` of each job."""
    nos, names, quality, health, (matrix, lengths, known) = held
    asked, sizes, given = vectors
    if matrix.shape[1] and asked.shape[1] and matrix.shape[1] != asked.shape[1]:
        raise ValueError("vectors differ in dimension")
    scored = bool(matrix.shape[1] and asked.shape[1])
    base = fixed.QUALITY_WEIGHT * quality + fixed.HEALTH_WEIGHT * health
    # the score is one product: of the vector and 1 with the weighted vector and the base
    order = np.argsort(-base, kind="stable")
    parts = [fixed.RELEVANCE_WEIGHT * _units(matrix[order], lengths[order])] if scored else []
    rows = np.column_stack([*parts, base[order]]).astype(np.float32)
    margin = np.float32(MARGIN + (rows.shape[1] + 4) * 2.0**-22)  # and what single precision may be off
    for start in range(0, len(jobs), BLOCK):
        part = slice(start, start + BLOCK)
        parts = [_units(asked[part], sizes[part])] if scored else []
        wanted = np.column_stack([*parts, np.ones(len(sizes[part]))]).astype(np.float32)
        x, y = _candidates(wanted, rows, k, margin)
        y = order[y]
        for at in range(0, len(x), PASSED):  # many more than k only where very many rows tie
            i, j = x[at : at + PASSED] + start, y[at : at + PASSED]
            cosine = _cosines(asked[i], matrix[j], sizes[i] * lengths[j]) if scored else np.zeros(len(i))
            columns = [take(jobs, pa.array(i)), pa.array(nos[j]), take(names, pa.array(j)), pa.array(quality[j]), pa.array(health[j])]
            columns.append(pa.array(cosine, mask=~(given[i] & known[j])))
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in NEAR.split(", ")])


def near_best(rows: DataFrame, jobs: DataFrame, pool: str, k: int, per_slice: int = SLICE, per_chunk: int = CHUNK) -> DataFrame:
    """``NEAR`` rows: for every job of ``(job_id, embedding, pool)`` those of its pool that may be
    among its best ``k``, with the exact cosine (null where either has no vector).

    ``rows`` is a written table ``(no, pool, full_name, embedding, quality_score, health_score)``;
    neither score is null. A job without pool has no rows.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sizes(df, name, held):
        many = F.ceil(F.count("*") / held).cast("int").alias(name)
        return df.filter(F.col(pool).isNotNull()).groupBy(F.col(pool).alias("_pool")).agg(many)

    # how many slices and chunks: one row per pool that has both
    tiles = sizes(rows, "slices", per_slice).join(sizes(jobs, "chunks", per_chunk), "_pool")

    def parts(own, other, key):
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own[:-1])
        return [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])]

    empty = lambda kind: F.lit(None).cast(kind)
    vector = F.col("embedding").cast(VECTOR).alias("v")
    left = rows.join(tiles, rows[pool] == tiles["_pool"]).select(
        F.col("_pool").alias("pool"), *parts("slices", "chunks", "no"), F.lit(0).alias("side"),
        empty("string").alias("job_id"), "no", "full_name", "quality_score", "health_score", vector,
    )
    right = jobs.join(tiles, jobs[pool] == tiles["_pool"]).select(
        F.col("_pool").alias("pool"), *parts("chunks", "slices", "job_id"), F.lit(1).alias("side"),
        F.col("job_id").cast("string").alias("job_id"), empty("long").alias("no"), empty("string").alias("full_name"),
        empty("double").alias("quality_score"), empty("double").alias("health_score"), vector,
    )
    dealt = left.unionByName(right).repartition(partitions, "pool", "slice", "chunk").sortWithinPartitions("pool", "slice", "chunk", "side")
    dealt = dealt.select(F.struct("pool", "slice", "chunk").alias("tile"), "side", "job_id", "no", "full_name", "quality_score", "health_score", "v")

    def match(batches):
        current, waiting, held = None, [], None
        for batch in batches:
            marks = list(zip(batch.column("tile").to_pylist(), batch.column("side").to_pylist()))
            marks = [(tuple(tile.values()), side) for tile, side in marks]
            edges = [0, *(n for n in range(1, len(marks)) if marks[n] != marks[n - 1]), len(marks)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                tile, side = marks[a]
                if tile != current:
                    current, waiting, held = tile, [], None
                part = batch.slice(a, b - a)
                if side == 0:
                    waiting.append(part)
                elif waiting or held:
                    if held is None:
                        all_rows = pa.Table.from_batches(waiting).combine_chunks()
                        column = lambda name, t=all_rows: t.column(name).combine_chunks()
                        numbers = [column(c).to_numpy() for c in ("no", "quality_score", "health_score")]
                        held = (numbers[0], column("full_name"), *numbers[1:], _vectors(column("v")))
                        waiting = []
                    yield from _near(part.column("job_id"), _vectors(part.column("v")), held, k)

    return dealt.mapInArrow(match, NEAR)
