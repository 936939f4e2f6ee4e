"""Packs documents into training sequences along a space-filling curve.

Each document is encoded once. Its tokens are hashed into `BUCKETS` counts, damped and
scaled to length one, and projected onto `DIMENSIONS` random directions; the position of
that point on a Hilbert curve is the document's key. Documents are range-sorted by key, so
neighbours in a sequence have similar content, and every task cuts its stretch of the curve
into sequences of `capacity` tokens. What is left at a stretch's end fills sequences whose
sizes are powers of two, so nothing is padded at all.

Ties of the key are broken by identifier, then by content: equal documents, of which there
may be very many, are spread over as many tasks as their tokens need.

Defined cases: null text is empty text, of which only the end token is packed; repeated
rows are packed each; rows without identifier come first among equals; other columns are
ignored; an empty table gives no pieces.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.bpe import word_ids
from reporank.session import written

BUCKETS, DIMENSIONS, LEVELS = 256, 4, 12  # the key has DIMENSIONS * LEVELS bits
STRETCH_BYTES = 64 << 20  # of ids that one task cuts, on average, at most
SEED = 20177

PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def hilbert(points: np.ndarray, levels: int) -> np.ndarray:
    """Hilbert index of integer points (one per row) in a cube of side 2**levels.

    Works on all points at once. From the coarsest bit down, every axis whose bit is set
    inverts the lower bits of the first axis, others swap them with it; the Gray code of
    the result, bit by bit over the axes, is the index (Skilling, 2004).
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(levels - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for i in range(axes):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(on, lower, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(levels - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(levels - 1, -1, -1):
        for i in range(axes):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


class Curve:
    """From the ids of a document to its place on the curve."""

    def __init__(self, vocabulary, buckets=BUCKETS, dimensions=DIMENSIONS, levels=LEVELS):
        self.bucket = ((np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
        self.bucket = self.bucket.astype(np.int64)
        self.buckets, self.levels = buckets, levels
        self.directions = np.random.default_rng(SEED).standard_normal((buckets, dimensions))

    def keys(self, documents):
        counts = np.array([np.bincount(self.bucket[ids], minlength=self.buckets) for ids in documents])
        vectors = np.log1p(counts.reshape(len(documents), self.buckets))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        side = 1 << self.levels
        # a projection of a unit vector onto a standard normal direction is mostly within 4
        cells = np.clip((vectors @ self.directions + 4) / 8 * side, 0, side - 1)
        return hilbert(cells.astype(np.int64), self.levels)


def cuts(n_tokens: int, capacity: int) -> list[int]:
    """Sizes of the sequences of a stretch: full ones, then falling powers of two."""
    rest = n_tokens % capacity
    return [capacity] * (n_tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Cutter:
    """Cuts a stream of documents into pieces; sequences are numbered from `first` on."""

    def __init__(self, capacity, first):
        self.capacity, self.sequence, self.used = capacity, first, 0
        self.open = []  # pieces of the sequence that is not full yet

    def add(self, identifier, ids):
        """Pieces of the sequences that this document fills."""
        done, start, total = [], 0, len(ids)
        while start < total:
            length = min(total - start, self.capacity - self.used)
            self.open.append((identifier, start, ids[start : start + length], total))
            start, self.used = start + length, self.used + length
            if self.used == self.capacity:
                done += self._close([self.capacity])
        return done

    def _close(self, sizes):
        """Lay the open pieces out in sequences of these sizes, cutting them where one ends."""
        out, sizes, offset = [], list(sizes), 0
        for identifier, start, ids, total in self.open:
            while len(ids):
                length = min(len(ids), sizes[0] - offset)
                crc = zlib.crc32(ids[:length].astype("<u4").tobytes())
                out.append((identifier, start, length, crc, total, self.sequence, offset))
                start, ids, offset = start + length, ids[length:], offset + length
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.sequence, offset = self.sequence + 1, 0
        self.open, self.used = [], 0
        return out

    def end(self):
        return self._close(cuts(self.used, self.capacity)) if self.used else []


def _encoded(path, end_id):
    def encode(batches):
        held = word_ids(path)
        curve = Curve(held.tokenizer.get_vocab_size())
        end = np.array([end_id], dtype=held.kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [held.ids(t.as_py() or "") for t in part.column("text")]
                arrays = [np.concatenate([np.frombuffer(x, dtype=held.kind), end]) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(curve.keys(arrays)),
                        pa.array([a.nbytes for a in arrays], pa.int64()),
                        pa.array([a.tobytes() for a in arrays], pa.binary()),
                    ],
                    ["doc_id", "key", "n_bytes", "ids"],
                )

    return encode


def _packed(path, capacity, schema):
    def pack(batches):
        kind = word_ids(path).kind
        cutter = Cutter(capacity, TaskContext.get().partitionId() << 40)

        def laid(pieces, identifiers):
            rows = list(zip(*pieces)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], identifiers), *(pa.array(np.array(c, dtype=np.int64)) for c in rows[1:])],
                schema,
            )

        identifiers = None
        for batch in batches:
            identifiers, pieces = batch.column("doc_id").type, []
            for identifier, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                pieces += cutter.add(identifier, np.frombuffer(ids.as_buffer(), dtype=kind))
            yield laid(pieces, identifiers)
        if identifiers is not None:
            yield laid(cutter.end(), identifiers)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset in the sequence.

    The encoded documents are written once (ids as 16-bit numbers where the vocabulary
    allows), so that neither the sampling for the range sort nor a lost executor encodes
    them again.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = written(rows.mapInArrow(_encoded(tokenizer, end_id), f"doc_id {kind}, key long, n_bytes long, ids binary"))
    order = ["key", "doc_id", F.crc32("ids")]
    total = encoded.agg(F.sum("n_bytes")).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, -(-total // STRETCH_BYTES))
    sorted_ = encoded.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    schema = PIECES.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    return sorted_.mapInArrow(_packed(tokenizer, capacity, names), schema).withColumnRenamed("doc_id", id_column)
