"""Connected components of an undirected graph: union-find in every task, then star rounds."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reporank.session import dropped, written_at

EDGES_HELD = 500_000  # by one task: bounds the memory of its union-find
ROWS_PASSED = 1 << 16  # rows of a forest that are handed on at a time


def _forest(held):
    """Function for mapInArrow that replaces a task's edges by (node, smallest node reached).

    A task that has seen more than ``held`` nodes hands on what it knows and starts anew: the rows
    still connect the same nodes, and no task's memory grows with its share of the edges.
    """

    def link(batches):
        import pyarrow as arrow

        parent = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def links(kind):
            nodes = [x for x in parent if parent[x] != x]
            for start in range(0, len(nodes), ROWS_PASSED):
                part = nodes[start : start + ROWS_PASSED]
                columns = [part, [root(x) for x in part]]
                yield arrow.RecordBatch.from_arrays(
                    [arrow.array(c, f.type) for c, f in zip(columns, kind)], schema=kind
                )

        for batch in batches:
            kind = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a), parent.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > held:
                yield from links(kind)
                parent.clear()
        if parent:
            yield from links(kind)

    return link


def _large_star(edges, least):
    """Link every larger neighbour of a node to the smallest node around it."""
    linked = _both(edges).join(least, "a").filter("b > a")
    return linked.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _both(edges):
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _small_star(edges, least):
    """Link every node and its smaller neighbours to the smallest of them."""
    linked = edges.join(least, "a").filter("b <> least")
    return linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))
    )


class _Round:
    """Tables of one round in the shared folder, deleted when the next one is there.

    The smallest neighbours are written before they are joined: only then does the join
    shuffle both of its sides, so that adaptive execution can split a star with many tips.
    """

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def landed(self, df):
        table, path = written_at(df)
        self.paths.append(path)
        return table

    def least(self, edges):
        return self.landed(edges.groupBy("a").agg(F.min("b").alias("least")))

    def edges(self, df):
        """The table, and a digest of it taken during the write."""
        mark, hashed = Observation(), F.xxhash64("a", "b")
        count = F.count(F.lit(1)).alias("n")
        seen = df.observe(mark, count, F.bit_xor(hashed).alias("x"), F.sum(hashed % (1 << 40)).alias("s"))
        return self.landed(seen), mark.get

    def following(self, edges):
        larger = self.landed(_large_star(edges, self.least(_both(edges))))
        return _small_star(larger, self.least(larger)).distinct()

    def delete(self):
        for path in self.paths:
            dropped(self.spark, path)


def connected_components(
    edges: DataFrame, a: str, b: str, held: int = EDGES_HELD
) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is its smallest node.

    Every task first contracts its own edges with a union-find, so that a task hands on
    fewer rows than it has nodes; these forests are then merged the same way by as many
    tasks as it takes to give each about ``held`` edges at most. No task holds more than
    twice as many nodes and those of a batch. A graph that one such task holds is finished
    by then. For what still spans tasks, each round rewrites the edge table (ids only) into
    the shared folder until a round changes nothing: stars around the smallest nodes are
    the only fixed point (Kiveris et al., 2014, O(log^2 n) rounds).
    Whether it changed is told by the write itself. Folders of finished rounds are deleted.

    Null ends are ignored; a node linked only to itself is not returned.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    own, link = _Round(spark), _forest(2 * held)  # held edges have no more nodes
    forest, state = own.edges(pairs.mapInArrow(link, pairs.schema))
    tasks = max(1, -(-state["n"] // held))
    merged = _Round(spark)
    current, state = merged.edges(forest.coalesce(tasks).mapInArrow(link, pairs.schema))
    own.delete()
    own = merged
    while tasks > 1:
        next_ = _Round(spark)
        following, seen = next_.edges(own.following(current))
        own.delete()
        same, own, current, state = seen == state, next_, following, seen
        if same:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots
    )
