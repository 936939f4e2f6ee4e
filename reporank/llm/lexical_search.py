"""Ranked lexical search: dense blocked products of item tiles and document impact tiles.

A document's impact for a term is an integer below 10**6, an item's weight for a term the
term's weight times its repeats in the item. The score, the sum of their products, is taken
tile by tile: at most `TILE_ITEMS` items are cut into tiles of at most `TILE_TERMS` of the
terms that these items use (their compact vocabulary), and every block of `DOCS` documents
becomes a dense matrix of impacts for these terms. One float64 matrix product per tile gives
partial sums; a tile ends before the weights of any of its items could bring a partial sum to
2**53, so each is an exact integer. Partial sums are added in 64-bit integers.

Of every block, each item keeps its `k` best documents; documents that tie with the last one
are compared by identifier before any is left out. What tasks have kept is merged by Spark.

The documents are read once for each block of items, and only counts of the block's terms are
kept of them (a written table). A block has about `ITEM_BYTES` bytes of item text, whatever
the number of items, and only one block is shipped to the tasks at a time.

Defined cases: null and empty texts have no terms: such a document is no document for the
statistics, such an item finds nothing and has no rows; rows that repeat a doc_id are ranked
each; documents without doc_id come last among equal scores; rows that repeat an item_id, and
items without one, are items of their own each; other columns are ignored; texts are cut into
terms in pieces of `PIECE` bytes at blanks, so a very long text needs no more than its bytes
and one piece's terms; empty tables give no rows.
"""

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank.llm.common import WORD_BYTES
from reporank.session import dropped, written, written_at

K, SCALE = 10, 1_000_000_000
TOP_IMPACT = 1_000_000  # no impact reaches it
TILE_ITEMS, TILE_TERMS, DOCS = 64, 1024, 1024
ITEM_BYTES = 8 << 20
PIECE = 4 << 20
BATCH_TERMS = 1 << 20  # terms counted at a time
PENDING = 1 << 17  # candidates of a task before they are cut to the best


def pieces(text: str | None, size: int = PIECE):
    """The terms of a text, a list for each piece of about `size` bytes."""
    data = (text or "").encode("utf-8", "replace").translate(WORD_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Vocabulary:
    """The items of one block as counts over their own numbered terms."""

    def __init__(self, rows: list[int], texts: list[str | None]):
        self.rows, self.number, entries = rows, {}, []
        for item, text in enumerate(texts):
            own = Counter()
            for terms in pieces(text):
                own.update(terms)
            entries += [(item, self.number.setdefault(t, len(self.number)), n) for t, n in own.items()]
        self.item, self.term, self.count = np.array(entries, dtype=np.int64).reshape(-1, 3).T


def tiles(vocabulary, weight: np.ndarray, items: int = TILE_ITEMS, terms: int = TILE_TERMS):
    """[(first item, number of items, [(terms, item, column, value)])] with bounded sums.

    Within one inner tuple the values of an item sum to less than 2**53 / `TOP_IMPACT`; a
    larger value is cut into several, which then lie in different tuples.
    """
    most = (1 << 53) // TOP_IMPACT - 1
    value = vocabulary.count * weight[vocabulary.term] if len(weight) else vocabulary.count
    out = []
    for first in range(0, len(vocabulary.rows), items):
        own = (vocabulary.item >= first) & (vocabulary.item < first + items) & (value > 0)
        item, term, left = vocabulary.item[own] - first, vocabulary.term[own], value[own]
        order = np.lexsort((item, term))
        held, sums, columns, parts = [], np.zeros(items, dtype=np.int64), {}, []

        def close():
            if held:
                i, c, v = np.array(held, dtype=np.int64).T
                parts.append((np.array(list(columns), dtype=np.int64), i, c, v.astype(np.float64)))
            held.clear(), columns.clear()
            sums[:] = 0

        for i, t, v in zip(item[order].tolist(), term[order].tolist(), left[order].tolist()):
            while v:
                if sums[i] >= most or (t not in columns and len(columns) >= terms):
                    close()
                some = min(v, most - int(sums[i]))
                held.append((i, columns.setdefault(t, len(columns)), some))
                sums[i] += some
                v -= some
        close()
        out.append((first, min(items, len(vocabulary.rows) - first), parts))
    return out


def _counted(docs, shipped, id_column, text_column):
    """doc_id, n (all terms), and the block's terms in it with their numbers of occurrences."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def lists(values, sizes):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))

    def count(batches):
        number = shipped.value
        get, width = number.get, max(1, len(number))

        def closed(ids, sizes, found):
            keys, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            each = np.bincount(keys // width, minlength=len(sizes))
            columns = [ids, pa.array(sizes, pa.int64()), lists(keys % width, each), lists(times, each)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

        for batch in batches:
            first, sizes, found, held = 0, [], [], 0
            for i, text in enumerate(batch.column("text")):
                n = 0
                for own in pieces(text.as_py()):
                    n += len(own)
                    known = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                    known = known[known >= 0]
                    found.append(known + len(sizes) * width)
                    held += len(known)
                sizes.append(n)
                if held >= BATCH_TERMS or i + 1 == batch.num_rows:
                    yield closed(batch.column("doc_id").slice(first, len(sizes)), sizes, found)
                    first, sizes, found, held = i + 1, [], [], 0

    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>").filter("n > 0")


def _document_counts(counted, width):
    """(term, df) over all rows; a task hands on one row for each term."""

    def count(batches):
        df = np.zeros(width, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    return counted.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The `k` best documents of every item so far."""

    def __init__(self, items, k):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.held, self.size = [], 0

    def add(self, first, scores, ids, missing):
        """Candidates of a block: scores by item (from `first` on) and document."""
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] > self.k:
            last = scores.shape[1] - self.k
            floor = np.maximum(floor, np.partition(scores, last, axis=1)[:, last])
        item, at = np.nonzero(scores >= floor[:, None])
        if len(item):
            self.held.append((item + first, scores[item, at], missing[at], ids[at]))
            self.size += len(item)
        if self.size >= PENDING:
            self.cut()

    def cut(self):
        if not self.held:
            return np.zeros((4, 0), dtype=np.int64)
        item, score, missing, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, missing, -score, item))
        item, score, missing, ids = item[order], score[order], missing[order], ids[order]
        begin = np.searchsorted(item, item)
        rank = np.arange(len(item)) - begin
        full = rank == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])
        stays = rank < self.k
        self.held = [(item[stays], score[stays], missing[stays], ids[stays])]
        self.size = int(stays.sum())
        return self.held[0]


def impacts(times, n, documents, terms):
    """Integer impact of every (document, term) count; `n` is the document's number of terms."""
    length = 25 + (75 * n * documents) // terms
    return (SCALE * times) // (1000 * times + 8 * length)


def _best(counted, shipped, documents, terms, width, k):
    """The best documents of each item within each task: row, doc_id, score."""

    def search(batches):
        rows, tiled = shipped.value
        best, column = Best(len(rows), k), np.full(width, -1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                n = batch.column("n").to_numpy()
                each = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                document = np.repeat(np.arange(len(n)), each)
                term = batch.column("terms").flatten().to_numpy().astype(np.int64)
                times = batch.column("times").flatten().to_numpy().astype(np.int64)
                impact = impacts(times, n[document], documents, terms).astype(np.float64)
                missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                for first, items, parts in tiled:
                    scores = np.zeros((items, len(n)), dtype=np.int64)
                    for own, item, place, value in parts:
                        column[own] = np.arange(len(own))
                        hit = column[term]
                        known = np.flatnonzero(hit >= 0)
                        column[own] = -1
                        dense = np.zeros((len(own), len(n)))
                        dense[hit[known], document[known]] = impact[known]
                        weights = np.zeros((items, len(own)))
                        weights[item, place] = value
                        scores += (weights @ dense).astype(np.int64)
                    best.add(first, scores, ids, missing)
        item, score, missing, ids = best.cut()
        columns = [pa.array(np.array(rows, np.int64)[item]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "score"])

    return counted.mapInArrow(search, "row long, doc_id long, score long")


def _block(docs, vocabulary, k, id_column, text_column):
    """Ranked rows of one block of items, written."""
    context = docs.sparkSession.sparkContext
    width = len(vocabulary.number)
    shipped = context.broadcast(vocabulary.number)
    counted, path = written_at(_counted(docs, shipped, id_column, text_column))
    documents, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(width, dtype=np.int64)
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1)
    found = _document_counts(counted, width).select("term", F.floor(1000 * F.log(ratio)).alias("w")).toArrow()
    weight[found.column("term").to_numpy()] = found.column("w").to_numpy()
    tiled = context.broadcast((vocabulary.rows, tiles(vocabulary, weight)))
    best = _best(counted, tiled, documents, max(1, terms), width, k)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = written(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    shipped.destroy(), tiled.destroy()
    dropped(docs.sparkSession, path)
    return ranked


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Each item's `k` best documents: item_id, rank (from 1), doc_id, score."""
    numbered = items.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text"))
    numbered = written(numbered.withColumn("row", F.monotonically_increasing_id()))
    size = numbered.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    out = None
    for block in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").toArrow()
        vocabulary = Vocabulary(own.column("row").to_pylist(), own.column("text").to_pylist())
        found = _block(docs, vocabulary, k, id_column, text_column)
        out = found if out is None else out.unionByName(found)
    named = out.join(numbered.select("row", "item_id"), "row")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
