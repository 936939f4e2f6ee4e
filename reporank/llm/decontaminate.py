"""Benchmark decontamination with suffix arrays over the training text.

Documents are read in shards of bounded size. Every shard gets a suffix array over its
words; every suffix of every benchmark item is looked up by binary search. Neighbours in
the array give its longest verbatim match; the range of suffixes that start with its first
`window` words gives all places where that window occurs. Matches never cross documents.

A suffix whose first word is in no item cannot match and stays out of the array. Documents
are never shuffled: each row is decided where it is read, so common passages and large
groups of copies cost no more than other text.

The benchmark is written to the shared folder in slices of about `SLICE_BYTES`, by a job of its
own, however large it is; tasks open one slice at a time and let it go for the next. Slices
hold whole items. The driver handles their names only.

A document with a hit also gets its longest verbatim match with any item: every match of a
window's length or more starts with a window, so it is found by extending those.

Defined cases: null and empty texts have no words and no hits; an item without words is in
no document; items and documents may repeat, each row gets its own answer, and repeated item
ids count once; null item ids are skipped; null document ids are returned as such; an empty
benchmark contaminates nothing; other columns are ignored.
"""

import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.common import words
from reporank.session import written
from reporank.sources.raw import _filesystem

SHARD_WORDS = 1 << 20
SLICE_BYTES = 4 << 20
CELLS = 1 << 20  # words compared at a time

DECIDED = "n_words long, n_hit long, items array<string>, longest long, longest_item string, longest_at long"
MATCHES = "item_id string, start int, n_words int, doc_id {id}, position long"


class Tests:
    """One slice of the benchmark: words as numbers from 1 on, items end to end, 0 between."""

    def __init__(self, items, window):
        self.ids, numbered, self.vocabulary = [], [], {}
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if item is not None and own:
                self.ids.append(str(item))
                numbered.append(own)
        lengths = np.array([len(x) for x in numbered], dtype=np.int64)
        self.longest = int(lengths.max(initial=0))
        pad = max(window, self.longest)
        self.text = np.array([w for own in numbered for w in [*own, 0]] + [0] * pad, dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1 if len(lengths) else lengths
        self.item = np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.suffix = np.repeat(starts, lengths) + self.at
        self.left = np.repeat(lengths, lengths) - self.at  # words from here to the item's end
        whole = np.minimum(window, lengths)[self.item] if len(lengths) else lengths
        self.needs = np.where(self.left >= whole, whole, 0)  # words of the window that starts here


def suffix_array(text, depth):
    """Start positions of all suffixes that begin with a word other than 0, in order.

    Suffixes are ordered by their first `depth` words at least; 0 ends a suffix. Words are
    compared four at a time, and only where all words before are the same.
    """
    bits = max(1, int(text.max(initial=0)).bit_length())
    step = max(1, 63 // bits)
    order = np.flatnonzero(text)
    padded = np.concatenate([text, np.zeros(depth + step, dtype=text.dtype)])

    def key(at):
        out = np.zeros(len(at), dtype=np.int64)
        alive = np.ones(len(at), dtype=bool)
        for k in range(step):
            word = np.where(alive, padded[at + k], 0)
            alive &= word > 0
            out = (out << bits) | word
        return out, alive

    keys, alive = key(order)
    by = np.argsort(keys, kind="stable")
    order, keys, alive = order[by], keys[by], alive[by]
    same = np.concatenate([[False], (keys[1:] == keys[:-1])]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(~same)  # number of the run of equal keys
    open_ = np.flatnonzero((same | np.concatenate([same[1:], [False]])) & alive) if len(keys) else np.zeros(0, int)
    offset = step
    while len(open_) and offset < depth:
        at, of = order[open_], group[open_]
        keys, alive = key(at + offset)
        by = np.lexsort((keys, of))
        order[open_], keys, alive, of = at[by], keys[by], alive[by], of[by]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])])
        # a run's later parts get numbers of their own; only equality is ever asked
        group[open_] = len(order) * (offset + 1) + np.cumsum(~same)
        open_ = open_[(same | np.concatenate([same[1:], [False]])) & alive]
        offset += step
    return order


def _bound(text, array, tests, lengths, upper):
    """Per suffix of `tests`, how many of the array's suffixes are below it (or equal, if
    `upper`) when both are cut to that many words. Looked up in blocks of bounded size."""
    rows = max(1, CELLS // max(1, int(lengths.max(initial=0))))
    blocks = [slice(i, i + rows) for i in range(0, len(lengths), rows)]
    found = [_bound_block(text, array, tests, tests.suffix[b], lengths[b], upper) for b in blocks]
    return np.concatenate([np.zeros(0, dtype=np.int64), *found])


def _bound_block(text, array, tests, suffix, lengths, upper):
    width = int(lengths.max(initial=1))
    wanted = tests.text[suffix[:, None] + np.arange(width)]
    wanted = np.where(np.arange(width) < lengths[:, None], wanted, -1)
    low = np.zeros(len(lengths), dtype=np.int64)
    high = np.full(len(lengths), len(array), dtype=np.int64)
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        mid = (low[going] + high[going]) // 2
        have = text[array[mid][:, None] + np.arange(width)]
        want = wanted[going]
        differs = (have != want) & (want >= 0)
        first = differs.argmax(axis=1)
        rows = np.arange(len(going))
        some = differs[rows, first]
        below = np.where(some, have[rows, first] < want[rows, first], upper)
        low[going] = np.where(below, mid + 1, low[going])
        high[going] = np.where(below, high[going], mid)


def _common(text, at, tests, which):
    """Words that the document's suffixes at `at` and the tests' suffixes share from their start."""
    length = np.zeros(len(at), dtype=np.int64)
    going = np.arange(len(at))
    while len(going):
        a = text[at[going] + length[going]]
        b = tests.text[tests.suffix[which[going]] + length[going]]
        going = going[(a == b) & (a > 0)]
        length[going] += 1
    return length


class Shard:
    """Some whole documents as one array of word numbers, 0 between them."""

    def __init__(self, documents, tests, window):
        sizes = np.array([len(x) for x in documents], dtype=np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        pad = max(window, tests.longest) + 1
        self.text = np.zeros(int(sizes.sum()) + len(sizes) + pad, dtype=np.int64)
        get = tests.vocabulary.get
        for begin, own in zip(self.begin.tolist(), documents):
            self.text[begin : begin + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
        self.array = suffix_array(self.text, pad)

    def windows(self, tests):
        """Document positions and test suffixes of all occurrences of windows."""
        low = _bound(self.text, self.array, tests, tests.needs, False)
        high = _bound(self.text, self.array, tests, tests.needs, True)
        count = np.where(tests.needs > 0, high - low, 0)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = self.array[np.repeat(low, count) + within]
        return at, np.repeat(np.arange(len(count)), count)

    def longest(self, tests):
        """For each test suffix the number of words of its longest match, and where it is."""
        if not len(self.array) or not len(tests.suffix):
            return np.zeros(len(tests.suffix), np.int64), np.zeros(len(tests.suffix), np.int64)
        place = _bound(self.text, self.array, tests, tests.left, False)
        best = np.zeros(len(place), dtype=np.int64)
        where = np.zeros(len(place), dtype=np.int64)
        for neighbour in (place - 1, place):
            at = self.array[np.clip(neighbour, 0, len(self.array) - 1)]
            found = _common(self.text, at, tests, np.arange(len(place)))
            better = found > best
            best, where = np.where(better, found, best), np.where(better, at, where)
        return best, where

    def document(self, at):
        return np.searchsorted(self.begin, at, side="right") - 1


def _slices(benchmark, item_column, text_column, window, slice_bytes):
    """Write the benchmark in slices; a function that gives one after the other in a task."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    count = max(1, -(-size // slice_bytes))

    def build(batches):
        items = [(r["item"], r["text"]) for b in batches for r in b.to_pylist()]
        if items:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(Tests(items, window)))], pa.binary())], ["tests"])

    slice_ = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    dealt = rows.repartitionById(count, slice_).sortWithinPartitions("row").select("item", "text")
    files = written(dealt.mapInArrow(build, "tests binary")).inputFiles()
    held = []

    def each():
        for file in files:
            if held[:1] != [file]:
                held.clear()
                system, path = _filesystem(file)
                with system.open_input_file(path) as opened:
                    blobs = pq.read_table(opened).column("tests").to_pylist()
                tests = []
                for blob in blobs:
                    one = Tests.__new__(Tests)
                    vars(one).update(pickle.loads(blob))
                    tests.append(one)
                held[:] = [file, tests]
            yield from held[1]

    return each


def _shards(batches, shard_words):
    """(identifier column, word lists) of whole documents, bounded but for a single one."""
    for batch in batches:
        ids, first, held, size = batch.column("doc_id"), 0, [], 0
        for i, text in enumerate(batch.column("text")):
            own = words(text.as_py())
            held.append(own)
            size += len(own)
            if size >= shard_words or i + 1 == batch.num_rows:
                yield ids.slice(first, len(held)), held
                first, held, size = i + 1, [], 0


def _decide(documents, slices, window, longest=False):
    """Words, hit words and item ids of each document and, if asked for, its longest match:
    (words, item, position), of equally long ones the smallest item and position."""
    sizes = np.array([len(x) for x in documents], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int64)
    items, best = [set() for _ in documents], [None] * len(documents)
    for tests in slices():
        shard = Shard(documents, tests, window)
        at, suffix = shard.windows(tests)
        length, item = tests.needs[suffix], tests.item[suffix]
        change += np.bincount(at, minlength=len(change)) - np.bincount(at + length, minlength=len(change))
        of = shard.document(at)
        for pair in np.unique(of * max(1, len(tests.ids)) + item).tolist():
            document, which = divmod(pair, len(tests.ids))
            items[document].add(tests.ids[which])
        if longest and len(at):
            common = _common(shard.text, at, tests, suffix)
            most = np.zeros(len(documents), dtype=np.int64)
            np.maximum.at(most, of, common)
            for i in np.flatnonzero(common == most[of]).tolist():
                d = int(of[i])
                one = (-int(common[i]), tests.ids[item[i]], int(at[i] - begin[d]))
                best[d] = one if best[d] is None else min(best[d], one)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    return sizes, hit[begin + sizes] - hit[begin], items, best


def _two(docs, id_column, text_column):
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    shard_words: int = SHARD_WORDS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids with a window in it), and its
    longest match: longest (words, 0 without a hit), longest_item and longest_at (word)."""
    slices = _slices(benchmark, item_column, text_column, window, slice_bytes)
    rows = _two(docs, id_column, text_column)

    def decide(batches):
        for ids, documents in _shards(batches, shard_words):
            n_words, n_hit, items, best = _decide(documents, slices, window, longest=True)
            lists = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            match = [
                pa.array([-b[0] if b else 0 for b in best], pa.int64()),
                pa.array([b and b[1] for b in best], pa.string()),
                pa.array([b and b[2] for b in best], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words), pa.array(n_hit), lists, *match],
                ["doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decide, f"doc_id {kind}, {DECIDED}")


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    shard_words: int = SHARD_WORDS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Longest verbatim match of every test suffix over all shards, and one place of it.

    item_id, start (word of the item), n_words, doc_id, position (word of the document);
    suffixes whose first word occurs nowhere are left out. Of equally long matches the one
    with the smallest doc_id and position is reported.
    """
    slices = _slices(benchmark, item_column, text_column, window, slice_bytes)
    rows = _two(docs, id_column, text_column)

    def search(batches):
        for ids, documents in _shards(batches, shard_words):
            for tests in slices():
                shard = Shard(documents, tests, window)
                best, where = shard.longest(tests)
                found = np.flatnonzero(best)
                of = shard.document(where[found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tests.ids[i] for i in tests.item[found].tolist()], pa.string()),
                        pa.array(tests.at[found], pa.int32()),
                        pa.array(best[found], pa.int32()),
                        ids.take(pa.array(of)),
                        pa.array(where[found] - shard.begin[of]),
                    ],
                    ["item_id", "start", "n_words", "doc_id", "position"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(search, MATCHES.format(id=kind))
    order = F.struct(-F.col("n_words"), F.col("doc_id"), F.col("position"))
    return (
        found.groupBy("item_id", "start")
        .agg(F.min(order).alias("best"))
        .select("item_id", "start", (-F.col("best.col1")).alias("n_words"), "best.doc_id", "best.position")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs.

    The decision is made in the task that reads the row; no join is needed.
    """
    text_column = options.pop("text_column", "text")
    slices = _slices(
        benchmark, options.pop("item_column", "item_id"), text_column, window, options.pop("slice_bytes", SLICE_BYTES)
    )
    shard_words = options.pop("shard_words", SHARD_WORDS)
    at = docs.columns.index(text_column)

    def keep(batches):
        for batch in batches:
            slim = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"]
            )
            for rows, documents in _shards([slim], shard_words):
                _, n_hit, _, _ = _decide(documents, slices, window)
                yield batch.take(rows.filter(pa.array(n_hit == 0)))

    return docs.mapInArrow(keep, docs.schema)


