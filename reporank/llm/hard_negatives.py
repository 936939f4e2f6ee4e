"""Hard negatives by score windows, with a multiway hyperplane tree (after GNAT; Brin, 1995).

Components are quantised to floor(256 x); scores are integer inner products. A tree of `DEPTH`
levels with up to `FAN` split points a node is drawn from a sample of at most `SAMPLE` rows;
every row goes to the closest split point (ties: the first), level by level, to a leaf. For
each split point of a node and each of its sibling subtrees, the least and the largest
distance from the point to any row of the subtree is taken over all rows, and so is the range
of lengths in the subtree.

A search wants rows whose score lies in a window [low, high], the best first. With the lengths
of a subtree the window becomes an annulus around the anchor: the squared distance is
|x|^2 + |q|^2 - 2 score. A subtree is left out if for one of the split points beside it the
distances that its range allows do not meet the annulus (triangle inequality), or if none of
its windows can be. The rows of the sample give every window a first bound: `k` of them in the
window mean that scores below the k-th need not be looked for. Leaves are scanned exactly.

Positives are such a search too: rows of the anchor's own label, with no upper end.

Every row is in the table of leaves; only the split points, their ranges and the sampled rows
are shipped to tasks, all of bounded size. A leaf of more than `HELD` rows is cut into slices.
Anchors stream past a slice, so their number is not bounded; the ones that visit a leaf carry
all their windows.

Defined cases: rows whose vec_id, label or vector is null, or whose vector is empty or has a
null or non-finite component, take no part; labels are whole numbers; components beyond +-2**27 after scaling are held there;
vectors of different lengths do not score with each other; rows that repeat a vec_id are rows
of their own each, so one may be the positive of the other; ties are broken by vec_id; an
anchor without a positive, and a window without rows, give no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank.session import written

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
LOWEST, HIGHEST, OUT_OF = 30, 90, 100  # of the positive's score
SAMPLE, FAN, DEPTH = 4096, 16, 2
HELD = 16384  # rows of one slice of a leaf
ASKED = 256  # anchors scored against a slice at a time
FULL = 1 << 27
NONE, ALL = -(1 << 62), 1 << 62  # ends of a window that has none


def quantised(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256.0 * flat.astype(np.float64)), -FULL, FULL).astype(np.int32)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of `a` with those of `b` (int32)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # then every partial sum of the float product is exact
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def lengths(a: np.ndarray) -> np.ndarray:
    """Squared lengths; as floats, for distances only."""
    return (a.astype(np.float64) ** 2).sum(axis=1)


def distances(a, b):
    """Distances of the rows of `a` to those of `b`, up to rounding."""
    squares = lengths(a)[:, None] + lengths(b)[None, :] - 2.0 * scores(a, b)
    return np.sqrt(np.maximum(0.0, squares))


def _spread(points, count, start=0):
    """Indices of points far from each other: always the one farthest from those taken."""
    taken, away = [start], distances(points, points[[start]])[:, 0]
    while len(taken) < min(count, len(points)) and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[[taken[-1]]])[:, 0])
    return np.array(taken)


class Tree:
    """Split points of every node, from sampled vectors of one length.

    `nodes[number]` are a node's split points; child j of node n is node n * fan + j + 1.
    """

    def __init__(self, sample, fan=FAN, depth=DEPTH):
        self.fan, self.depth, self.nodes = fan, depth, {}
        self._grow(0, sample, depth)

    def _grow(self, number, points, depth):
        self.nodes[number] = points[_spread(points, self.fan)]
        if depth > 1:
            child = distances(points, self.nodes[number]).argmin(axis=1)
            for j in range(len(self.nodes[number])):
                self._grow(number * self.fan + j + 1, points[child == j], depth - 1)

    def place(self, rows):
        """Leaf of each row, and for each level (node, child, distances to the split points)."""
        at, path = np.zeros(len(rows), dtype=np.int64), []
        for _ in range(self.depth):
            away = np.full((len(rows), self.fan), np.inf)
            for node in np.unique(at).tolist():
                own = at == node
                away[own, : len(self.nodes[node])] = distances(rows[own], self.nodes[node])
            child = away.argmin(axis=1)
            path.append((at, child, away))
            at = at * self.fan + child + 1
        return at, path

    def subtree_ranges(self, rows):
        """(subtree, split point, least, largest) for rows; split point -1: squared lengths."""
        out, squares = {}, lengths(rows)
        _, path = self.place(rows)
        for node, child, away in path:
            subtree = node * self.fan + child + 1
            for s in np.unique(subtree).tolist():
                own = subtree == s
                out[s, -1] = squares[own].min(), squares[own].max()
                low, high = away[own].min(axis=0), away[own].max(axis=0)
                for i in range(len(self.nodes[(s - 1) // self.fan])):
                    out[s, i] = low[i], high[i]
        return out

    def leaves(self, rows, low, high, ranges):
        """(row, leaf) that may hold a score in one of the row's windows (rows x windows)."""
        squares, out = lengths(rows), []
        reach = {0: np.ones(len(rows), dtype=bool)}
        for level in range(self.depth):
            following = {}
            for node, asked in reach.items():
                away = distances(rows, self.nodes[node])
                for j in range(len(self.nodes[node])):
                    subtree = node * self.fan + j + 1
                    if (subtree, -1) in ranges:  # some row lies there
                        meets = asked & self._meets(subtree, away, squares, low, high, ranges)
                        if meets.any():
                            following[subtree] = meets
            reach = following
        for leaf, asked in reach.items():
            row = np.flatnonzero(asked)
            out.append((row, np.full(len(row), leaf)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(r for r, _ in out)]), np.concatenate([none, *(x for _, x in out)])

    @staticmethod
    def _meets(subtree, away, squares, low, high, ranges):
        shortest, longest = ranges[subtree, -1]
        slack = 1e-6 * (1 + longest + squares)  # of squares, beyond all rounding
        inner = np.sqrt(np.maximum(0, shortest + squares[:, None] - 2.0 * high - slack[:, None]))
        outer_square = longest + squares[:, None] - 2.0 * low + slack[:, None]
        outer = np.sqrt(np.maximum(0, outer_square))
        meets = (low <= high) & (outer_square >= 0)
        for i in range(away.shape[1]):
            if (subtree, i) not in ranges:
                continue
            near, far = ranges[subtree, i]
            gap = np.sqrt(slack)
            least = np.maximum(away[:, i] - far, near - away[:, i]) - gap
            most = away[:, i] + far + gap
            meets &= (outer >= least[:, None]) & (inner <= most[:, None])
        return meets.any(axis=1)


def best_of(found: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of `found` among `valid` positions, equal ones in order."""
    at = np.flatnonzero(valid)
    if len(at) > k:
        own = found[at]
        last = np.partition(own, len(at) - k)[len(at) - k]
        above = at[own > last]
        at = np.concatenate([above, at[own == last][: k - len(above)]])
    return at[np.lexsort((at, -found[at]))]


def _matrix(column, dims):
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=np.int32).reshape(len(column), dims)


def _windows(batch, name):
    column = batch.column(name)
    return column.flatten().to_numpy().reshape(len(column), -1)


def _rows(vectors, id_column, vector_column, label_column):
    """(row, vec_id, label, dims, v) of the rows that take part, numbered and written."""
    vector = F.col(vector_column)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), vector.alias("x")
    )
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)).filter(finite)

    def quantise(batches):
        for batch in batches:
            column = batch.column("x")
            flat, each = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
            data, end = quantised(flat.to_numpy(zero_copy_only=False)), np.cumsum(each)
            packed = [data[e - n : e].tobytes() for e, n in zip(end, each)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(each, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dims", "v"])

    packed = rows.mapInArrow(quantise, "vec_id long, label long, dims int, v binary")
    return written(packed.withColumn("row", F.monotonically_increasing_id()))


def _ranges(rows, tree, dims):
    """The ranges of all subtrees; at most one row for each split point and child comes back."""

    def take(batches):
        found = {}
        for batch in batches:
            for key, (low, high) in tree.subtree_ranges(_matrix(batch.column("v"), dims)).items():
                least, most = found.get(key, (low, high))
                found[key] = min(low, least), max(high, most)
        columns = [[s for s, _ in found], [i for _, i in found], [r[0] for r in found.values()], [r[1] for r in found.values()]]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["s", "i", "low", "high"])

    parts = rows.select("v").mapInArrow(take, "s long, i long, low double, high double")
    found = parts.groupBy("s", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return {(r.s, r.i): (r.low, r.high) for r in found}


class _Index:
    """Rows of one vector length in leaves, and what is known of the leaves."""

    def __init__(self, rows, dims, sample, fan, depth, held):
        self.dims, self.held = dims, held
        rows = rows.filter(F.col("dims") == dims)
        drawn = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "vec_id", "label", "v").toArrow()
        drawn = drawn.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.sample = _matrix(drawn.column("v"), dims)
        self.sample_row, self.sample_label = (drawn.column(c).to_numpy() for c in ("row", "label"))
        self.tree = tree = Tree(self.sample, fan, depth)
        self.ranges = _ranges(rows, tree, dims)

        def house(batches):
            for batch in batches:
                leaf, _ = tree.place(_matrix(batch.column("v"), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        slim = rows.select("row", "vec_id", "label", "v")
        self.housed = written(slim.mapInArrow(house, "row long, vec_id long, label long, v binary, leaf long"))
        counts = self.housed.groupBy("leaf").count().collect()  # at most fan ** depth leaves
        self.slices = {r.leaf: -(-r["count"] // held) for r in counts}

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, window, vec_id, score, rank): the k best rows in each window of each anchor.

        `asked`: row, label, v, low, high (arrays of equal lengths), one row per anchor.
        """
        dims, tree, ranges, slices = self.dims, self.tree, self.ranges, self.slices
        sample, sample_row, sample_label = self.sample, self.sample_row, self.sample_label

        def bounded(found, valid, low, high):
            """The k-th best of the sample in a window, a lower bound for what can be wanted."""
            at = best_of(found, valid & (found >= low) & (found <= high), k)
            return max(low, int(found[at[-1]])) if len(at) == k else low

        def visit(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, ASKED):
                    batch = whole.slice(start, ASKED)
                    v, row, label = _matrix(batch.column("v"), dims), batch.column("row").to_numpy(), batch.column("label").to_numpy()
                    low, high = _windows(batch, "low").copy(), _windows(batch, "high")
                    found = scores(v, sample)
                    for r in range(len(v)):
                        valid = (sample_row != row[r]) & ((sample_label == label[r]) == same)
                        for w in range(low.shape[1]):
                            low[r, w] = bounded(found[r], valid, low[r, w], high[r, w])
                    at, leaf = tree.leaves(v, low.astype(np.float64), high.astype(np.float64), ranges)
                    times = np.array([slices.get(x, 0) for x in leaf.tolist()], dtype=np.int64)
                    at, leaf = np.repeat(at, times), np.repeat(leaf, times)
                    slice_ = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    columns = [batch.column(c).take(pa.array(at)) for c in ("row", "label", "v")]
                    ends = [pa.array(list(x[at]), pa.list_(pa.int64())) for x in (low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf), pa.array(slice_), *columns, *ends], ["leaf", "slice", "row", "label", "v", "low", "high"]
                    )

        kinds = "leaf long, slice long, row long, label long, v binary, low array<long>, high array<long>"
        visits = asked.select("row", "label", "v", "low", "high").mapInArrow(visit, kinds)
        count = F.element_at(F.create_map(*(F.lit(x) for pair in slices.items() for x in pair)), F.col("leaf"))
        ends = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high")]
        held = self.housed.withColumn("slice", F.pmod(F.xxhash64("row"), count))
        one = held.select("leaf", "slice", F.lit(0).alias("side"), "vec_id", "row", "label", "v", *ends)
        other = visits.select("leaf", "slice", F.lit(1).alias("side"), F.lit(None).cast("long").alias("vec_id"), "row", "label", "v", "low", "high")
        met = one.unionByName(other)
        # the rows of a slice come first, in the order that breaks ties, then the anchors
        partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = met.repartition(partitions, "leaf", "slice").sortWithinPartitions("leaf", "slice", "side", "vec_id", "row")

        def scan(batches):
            name, parts, here = None, [], None
            for whole in batches:
                place = list(zip(*(whole.column(c).to_pylist() for c in ("leaf", "slice", "side"))))
                cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    if place[a][:2] != name:
                        name, parts, here = place[a][:2], [], None
                    own = whole.slice(a, b - a)
                    if place[a][2] == 0:
                        parts.append(tuple(own.column(c).to_numpy() for c in ("vec_id", "row", "label")) + (_matrix(own.column("v"), dims),))
                        continue
                    if here is None and parts:
                        here = tuple(np.concatenate(c) for c in zip(*parts))
                        parts = []
                    if here is not None:
                        for at in range(0, b - a, ASKED):
                            yield self_scan(own.slice(at, ASKED), here)

        def self_scan(batch, here):
            vec_id, row, label, v = here
            found = scores(_matrix(batch.column("v"), dims), v)
            anchor, own_label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            low, high = _windows(batch, "low"), _windows(batch, "high")
            out = []
            for r in range(len(anchor)):
                valid = (row != anchor[r]) & ((label == own_label[r]) == same)
                for w in range(low.shape[1]):
                    at = best_of(found[r], valid & (found[r] >= low[r, w]) & (found[r] <= high[r, w]), k)
                    out.append((np.full(len(at), anchor[r]), np.full(len(at), w, np.int32), row[at], vec_id[at], found[r][at]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "window", "other", "vec_id", "score"])

        best = met.mapInArrow(scan, "row long, window int, other long, vec_id long, score long")
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id", "other")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _mined(index, rows, every, positives, negatives):
    anchors = rows.filter((F.col("dims") == index.dims) & (F.col("vec_id") % every == 0)).select("row", "vec_id", "label", "v")

    def ends(x):
        return F.array(F.lit(x).cast("long"))

    open_ = anchors.select("*", ends(NONE).alias("low"), ends(ALL).alias("high"))
    near = written(index.search(open_, True, positives).select("row", "rank", "other", "vec_id", "score"))
    # windows [ceil(30 p / 100), floor(90 p / 100)] in whole numbers, one for each positive
    score = F.col("score").cast("decimal(25,0)")
    low = F.ceil(score * LOWEST / OUT_OF).cast("long")
    high = F.floor(score * HIGHEST / OUT_OF).cast("long")
    asked = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    # all anchors have arrays of one length; a window without a positive is empty
    at = [F.get("w", F.lit(i)) for i in range(positives)]
    lows = F.array(*(F.coalesce(x["low"], F.lit(1).cast("long")) for x in at))
    highs = F.array(*(F.coalesce(x["high"], F.lit(0).cast("long")) for x in at))
    asked = written(anchors.join(asked, "row").select("row", "label", "v", lows.alias("low"), highs.alias("high")))
    found = index.search(asked, False, negatives)
    positive = near.select("row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(positive, ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    sample: int = SAMPLE,
    fan: int = FAN,
    depth: int = DEPTH,
    held: int = HELD,
) -> DataFrame:
    """Per anchor, positive and rank: negative_id and both scores.

    Anchors are the rows whose identifier is divisible by `every`.
    """
    rows = _rows(vectors, id_column, vector_column, label_column)
    out = None
    for r in sorted(r.dims for r in rows.select("dims").distinct().collect()):  # vector lengths: a handful
        found = _mined(_Index(rows, r, sample, fan, depth, held), rows, every, positives, negatives)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], kinds)
    return out
