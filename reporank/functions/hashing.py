"""Tokens of Arrow string arrays and their seeded 32-bit murmur3 hashes, with numpy.

Spark's own ``hash`` treats the last 1-3 bytes of a string differently and has
no seed argument, so it cannot give the same fingerprints.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reporank import fixed

# The 32-bit murmur3 constants.
BLOCK_1, BLOCK_2, STEP = 0xCC9E2D51, 0x1B873593, 0xE6546B64
FINAL_1, FINAL_2 = 0x85EBCA6B, 0xC2B2AE35

_U = np.uint32


def _rotl(x, bits):
    return (x << _U(bits)) | (x >> _U(32 - bits))


def _scrambled(k):
    return _rotl(k * _U(BLOCK_1), 15) * _U(BLOCK_2)


def _hash_same_length(data, seeds):
    """Hashes of an (n, length) byte matrix under every seed, as (n, seeds)."""
    n, length = data.shape
    whole = length // 4
    blocks = _scrambled(np.ascontiguousarray(data[:, : whole * 4]).view("<u4").astype(_U))
    h = np.repeat(seeds[None, :], n, axis=0)
    for b in range(whole):
        h ^= blocks[:, b : b + 1]
        h = _rotl(h, 13) * _U(5) + _U(STEP)
    if length % 4:
        tail = np.zeros((n, 4), np.uint8)
        tail[:, : length % 4] = data[:, whole * 4 :]
        h ^= _scrambled(tail.view("<u4").astype(_U))
    h ^= _U(length)
    h ^= h >> _U(16)
    h *= _U(FINAL_1)
    h ^= h >> _U(13)
    h *= _U(FINAL_2)
    h ^= h >> _U(16)
    return h


def _bytes(texts: pa.Array):
    """Offsets and UTF-8 bytes of a string array; nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    return offsets, data


_SPACES = [c.encode() for c in fixed.WHITESPACE]
_IS_SPACE_BYTE = np.zeros(256, bool)
_IS_SPACE_BYTE[[c[0] for c in _SPACES if len(c) == 1]] = True
_IS_LEAD_BYTE = np.zeros(256, bool)
_IS_LEAD_BYTE[[c[0] for c in _SPACES if len(c) > 1]] = True


def _space_mask(data):
    mask = _IS_SPACE_BYTE[data]
    lead = np.flatnonzero(_IS_LEAD_BYTE[data])
    for space in _SPACES if len(lead) else ():
        if len(space) > 1:
            at = lead[lead <= len(data) - len(space)]
            for i, byte in enumerate(space):
                at = at[data[at + i] == byte]
            for i in range(len(space)):
                mask[at + i] = True
    return mask


def white_space_tokens(texts: pa.Array):
    """All tokens of all texts in order, and the row each one belongs to."""
    offsets, data = _bytes(texts)
    base, end = int(offsets[0]), int(offsets[-1])
    offsets, data = offsets - base, data[base:end]
    space = _space_mask(data)
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    after = np.concatenate(([True], space))[:-1] | border[:-1]
    before = np.concatenate((space, [True]))[1:] | border[1:]
    first, last = np.flatnonzero(~space & after), np.flatnonzero(~space & before)
    starts = np.concatenate(([0], np.cumsum(last - first + 1)))
    kept = pa.py_buffer(data[~space])
    tokens = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(starts.astype(np.int64)), kept]
    )
    return tokens, np.searchsorted(offsets, first, side="right") - 1


def token_hashes(tokens: pa.Array, seeds) -> np.ndarray:
    """One row per token, one uint32 column per seed."""
    seeds = np.asarray(seeds, dtype=_U)
    offsets, data = _bytes(tokens)
    lengths = np.diff(offsets)
    out = np.empty((len(tokens), len(seeds)), _U)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        out[rows] = _hash_same_length(
            data[offsets[rows][:, None] + np.arange(length)[None, :]], seeds
        )
    return out
