"""Vector expressions: cosine similarity, embedding, JSON text form."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reporank import fixed
from reporank.functions.hashing import token_hashes, white_space_tokens
from reporank.functions.text import _col
from reporank.schemas import VECTOR


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity of two vector columns; 0 when either has no length.

    Vectors of different dimension are an error, not a silent truncation.
    """
    a, b = _col(a).cast(VECTOR), _col(b).cast(VECTOR)
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension"))
    ).otherwise(F.when(size == 0, 0.0).otherwise(_dot(a, b) / size))


def as_matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Arrow list array without nulls as an (n, dims) float64 matrix."""
    if pc.any(pc.not_equal(pc.list_value_length(vectors), dims)).as_py():
        raise ValueError("vectors differ in dimension")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def cosine_to(vector, column) -> Column:
    """Cosine similarity of a vector column to one given vector, null for null.

    One matrix-vector product per Arrow batch; the given vector is a constant of
    the plan, so there is no join.
    """
    query = np.asarray(vector, dtype=np.float64)
    query_size = np.linalg.norm(query)

    @F.arrow_udf(T.DoubleType())
    def similarity(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid()
        matrix = as_matrix(vectors.drop_null(), len(query))
        size = np.linalg.norm(matrix, axis=1) * query_size
        score = np.divide(matrix @ query, size, out=np.zeros(len(matrix)), where=size != 0)
        out = np.zeros(len(vectors))
        known = present.to_numpy(zero_copy_only=False)
        out[known] = score
        return pa.array(out, mask=~known)

    return similarity.asNondeterministic()(_col(column))  # see minhash: called once per row


@F.arrow_udf(T.DoubleType())
def _row_cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(a.is_valid(), b.is_valid())
    a, b = a.filter(known), b.filter(known)
    out, known = np.zeros(len(known)), known.to_numpy(zero_copy_only=False)
    if len(a):
        dims = len(a[0])
        a, b = as_matrix(a, dims), as_matrix(b, dims)
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        dots = np.einsum("ij,ij->i", a, b)
        out[known] = np.divide(dots, size, out=np.zeros(len(a)), where=size != 0)
    return pa.array(out, mask=~known)


def cosine_rows(a, b) -> Column:
    """Like :func:`cosine`, by Arrow batch: faster for long vectors."""
    return _row_cosine.asNondeterministic()(_col(a), _col(b))


def hashed_embedding(text, dims: int = fixed.EMBEDDING_DIMS) -> Column:
    """Unit vector of signed token counts hashed into ``dims`` slots.

    Deterministic and model-free; it reflects shared words, not meaning.
    A text without tokens gives the zero vector.
    """

    @F.arrow_udf(VECTOR)
    def encode(texts: pa.Array) -> pa.Array:
        tokens, owner = white_space_tokens(texts)
        words = tokens.dictionary_encode()
        slot_hash, sign_hash = token_hashes(words.dictionary, [0, 1]).T
        pick = words.indices.to_numpy()
        slot = (slot_hash % dims)[pick].astype(np.int64)
        sign = 1.0 - 2.0 * (sign_hash & 1)[pick]
        counts = np.bincount(owner * dims + slot, sign, len(texts) * dims)
        counts = counts.astype(np.float64).reshape(-1, dims)
        size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, size, out=counts, where=size != 0)
        offsets = np.arange(0, unit.size + 1, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return encode.asNondeterministic()(F.lower(_col(text)))


def embed(
    text,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    batch: int = fixed.EMBEDDING_BATCH,
) -> Column:
    """Unit embedding of a text column.

    ``make_encoder`` is called once per task and returns a function from a list
    of texts to a matrix; without it, texts are embedded by feature hashing.
    """
    if make_encoder is None:
        return hashed_embedding(text)

    @F.arrow_udf(VECTOR)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:
            rows = []
            for start in range(0, len(texts), batch):
                matrix = np.asarray(encoder(texts.slice(start, batch).to_pylist()), np.float64)
                size = np.linalg.norm(matrix, axis=1, keepdims=True)
                rows.extend(np.divide(matrix, size, out=matrix, where=size != 0))
            yield pa.array(rows, pa.list_(pa.float64()))

    return encode.asNondeterministic()(F.coalesce(_col(text), F.lit("")))


def vector_from_json(text) -> Column:
    return F.from_json(_col(text), VECTOR)


def vector_to_json(vector) -> Column:
    return F.to_json(_col(vector))
