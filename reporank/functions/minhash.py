"""MinHash fingerprints, band keys and the similarity they estimate."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reporank import fixed
from reporank.functions.hashing import token_hashes, white_space_tokens
from reporank.functions.text import _col
from reporank.schemas import FINGERPRINT

CHUNK = 1 << 14  # token occurrences whose hashes are gathered at a time (8 MB), whatever the text length
HELD_TOKENS = 1 << 16  # different tokens of a piece that are hashed once for all chunks (32 MB)
TEXT_BYTES = 1 << 23  # text that is cut into tokens at a time, but one whole text at least
HELD_KEYS = 1 << 14  # fingerprints a task folds before it passes them on (8 MB)
PRINT_BYTES = fixed.NUM_HASHES * 4  # of a fingerprint
_SEEDS = np.arange(fixed.NUM_HASHES, dtype=np.uint32)


def _minima(values: pa.Array, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Element-wise minimum of the hashes of ``values``, per row (``rows`` ascending)."""
    out = np.full((n_rows, fixed.NUM_HASHES), fixed.EMPTY_MINIMUM, np.uint32)
    whole = values.dictionary_encode()
    once = len(whole.dictionary) <= HELD_TOKENS
    if once:
        hashes, picks = token_hashes(whole.dictionary, _SEEDS), whole.indices.to_numpy()
    for start in range(0, len(values), CHUNK):
        if once:
            pick = picks[start : start + CHUNK]
        else:
            part = values.slice(start, CHUNK).dictionary_encode()
            hashes, pick = token_hashes(part.dictionary, _SEEDS), part.indices.to_numpy()
        owner = rows[start : start + CHUNK]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(hashes[pick], first, axis=0)
        out[owner[first]] = np.minimum(out[owner[first]], least)
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel().astype(np.int64)))


def _pieces(texts: pa.Array):
    """``(start, end)`` of successive rows with about ``TEXT_BYTES`` of text.

    Tokens and their places take many times the bytes of their text, so a task holds those of
    one piece, however many rows Spark puts into a batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + TEXT_BYTES, side="right")))
        yield start, end
        start = end


@F.arrow_udf(FINGERPRINT)
def _fingerprints(texts: pa.Array) -> pa.Array:
    out = np.empty((len(texts), fixed.NUM_HASHES), np.uint32)
    for start, end in _pieces(texts):
        tokens, owner = white_space_tokens(texts.slice(start, end - start))
        out[start:end] = _minima(tokens, owner, end - start)
    return _lists(out)


# The same text always gives the same fingerprint. The mark keeps the optimizer
# from copying the call into pushed-down filters, where it would run again.
_fingerprints = _fingerprints.asNondeterministic()


@F.arrow_udf(FINGERPRINT)
def _long_fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprints of the texts that are there, null for the others."""
    given = texts.is_valid().to_numpy(zero_copy_only=False)
    prints = _lists(_key_minima(texts.drop_null(), np.arange(given.sum()), int(given.sum())))
    return prints.take(pa.array(np.cumsum(given) - 1, pa.int64(), mask=~given))


_long_fingerprints = _long_fingerprints.asNondeterministic()


def text_or_minhash(text) -> tuple[Column, Column]:
    """The text itself where it is shorter than a fingerprint, and else its fingerprint.

    One of the two is null, for a null text both. :func:`minhash_by` takes them together.
    """
    short = F.octet_length(_col(text)) <= PRINT_BYTES
    return F.when(short, _col(text)), _long_fingerprints(F.when(~short, _col(text)))


def minhash(text) -> Column:
    """128 seeded minima over the white-space tokens of one text. No shuffle."""
    return _fingerprints(_col(text))


def _grouped(batch):
    """Keys of a batch, and its texts in the order of their keys with the key of each one."""
    keys = batch.column(0).dictionary_encode(null_encoding="encode")
    order = np.argsort(keys.indices.to_numpy(), kind="stable")
    return keys.dictionary, batch.column(1).take(pa.array(order)), keys.indices.to_numpy()[order]


def _key_minima(texts, owner, n_keys):
    """Fingerprints of ``n_keys`` keys; ``owner`` is the ascending key of each text."""
    out = np.full((n_keys, fixed.NUM_HASHES), fixed.EMPTY_MINIMUM, np.uint32)
    for start, end in _pieces(texts):
        tokens, row = white_space_tokens(texts.slice(start, end - start))
        first, last = owner[start], owner[end - 1] + 1
        minima = _minima(tokens, owner[start:end][row] - first, last - first)
        out[first:last] = np.minimum(out[first:last], minima)
    return out


def minhash_by(df: DataFrame, key: str, text: str, fingerprint: str | None = None) -> DataFrame:
    """One fingerprint per key over many rows of text, as ``(key, minhash_fingerprint)``.

    What is shuffled is never longer than the text: of every batch, keys with more text than a
    fingerprint takes are folded to one at once, however many rows a key has; the texts of all
    others travel, joined to one per key. Fingerprints are made where a key's texts meet, and
    merge by element-wise minimum. Where rows have a ``fingerprint`` instead of a text, those are
    merged with the others; a key without either has no row then.
    """

    def packed(keys, texts, prints):
        columns = [pa.array(keys, key_type), pa.array(texts, pa.string()), prints]
        return pa.RecordBatch.from_arrays(columns, ["key", "text", "fp"])

    def reduced(batches):
        for batch in batches:
            keys, texts, owner = _grouped(batch)
            texts = pc.fill_null(texts, "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            long = np.bincount(owner, sizes, len(keys)) > PRINT_BYTES
            ends = np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32)
            names, rest = keys.to_pylist(), np.flatnonzero(~long)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts), " ") if len(rest) else None
            if len(rest):
                none = pa.nulls(len(rest), pa.list_(pa.int64()))
                yield packed([names[i] for i in rest], joined.take(pa.array(rest)), none)
            if long.any():
                mask = long[owner]
                number = np.cumsum(long) - 1
                prints = _key_minima(texts.filter(pa.array(mask)), number[owner[mask]], int(long.sum()))
                yield packed([names[i] for i in np.flatnonzero(long)], [None] * len(prints), _lists(prints))

    def fold(batches):
        held = {}
        for batch in batches:
            keys, texts, owner = _grouped(batch)
            made = _key_minima(texts, owner, len(keys))
            given = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            if given.any():
                at = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()[given]
                prints = batch.column(2).drop_null().flatten().to_numpy().reshape(-1, fixed.NUM_HASHES)
                np.minimum.at(made, at, prints.astype(np.uint32))
            for name, fp in zip(keys.to_pylist(), made):
                known = held.get(name)
                # a copy: a row alone would keep the whole batch's matrix
                held[name] = fp.copy() if known is None else np.minimum(known, fp)
            if len(held) >= HELD_KEYS:
                yield packed(list(held), [None] * len(held), _lists(np.stack(list(held.values()))))
                held = {}
        if held:
            yield packed(list(held), [None] * len(held), _lists(np.stack(list(held.values()))))

    texts = df if fingerprint is None else df.filter(F.col(text).isNotNull())
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["key"], T.StructField("text", T.StringType()), T.StructField("fp", FINGERPRINT)])
    key_type = to_arrow_type(slim.schema["key"].dataType)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = slim.mapInArrow(reduced, schema).repartition(partitions, "key")
    folded = met.mapInArrow(fold, schema).select("key", "fp")
    if fingerprint is not None:
        given = df.filter(F.col(fingerprint).isNotNull())
        folded = folded.unionByName(given.select(F.col(key).alias("key"), F.col(fingerprint).alias("fp")))
    return merged_fingerprints(folded, "key", "fp").withColumnRenamed("key", key)


def merged_fingerprints(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Element-wise minimum of the fingerprints of each key; partial in every task."""
    minima = [F.min(F.col(fingerprint)[i]) for i in range(fixed.NUM_HASHES)]
    return df.groupBy(key).agg(F.array(*minima).alias("minhash_fingerprint"))


def has_tokens(fingerprint) -> Column:
    """False for a missing fingerprint and for that of a repo without any token."""
    fp = _col(fingerprint)
    filled = fp.isNotNull() & (F.size(fp) > 0) & (F.array_min(fp) < fixed.EMPTY_MINIMUM)
    return F.coalesce(filled, F.lit(False))


def band_keys(fingerprint) -> Column:
    """One hash key per band of eight minima, in band order."""

    def key(band):
        rows = F.slice(_col(fingerprint), band * fixed.BAND_ROWS + 1, fixed.BAND_ROWS)
        return F.md5(F.array_join(rows.cast("array<string>"), ","))

    return F.array(*[key(band) for band in range(fixed.NUM_BANDS)])


def jaccard_estimate(left, right) -> Column:
    """Share of equal minima, the estimate of the Jaccard similarity of the token sets."""
    same = F.zip_with(_col(left), _col(right), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(fixed.NUM_HASHES))
