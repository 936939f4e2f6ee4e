"""The E8 lattice: nearest points, neighbouring cells, hashes of them."""

import itertools

import numpy as np

from reporank.llm.rolling import mixed

DIMENSIONS = 8


def shortest() -> np.ndarray:
    """The 240 shortest vectors: what leads from a cell to those that touch it most."""
    pairs = [
        [a if x == i else b if x == j else 0 for x in range(DIMENSIONS)]
        for i, j in itertools.combinations(range(DIMENSIONS), 2)
        for a in (1, -1)
        for b in (1, -1)
    ]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=DIMENSIONS) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves], dtype=np.float64)


def _even(points):
    """Nearest integer points whose coordinates have an even sum."""
    near = np.rint(points)
    away = points - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(away[odd]).argmax(axis=1)
    near[odd, worst] += np.where(away[odd, worst] >= 0, 1, -1)
    return near


def nearest(points: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: of the even integer points or these moved by 1/2."""
    whole, half = _even(points), _even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cells(points: np.ndarray, probes: int, seed: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Hashes of the own cell of each row, and of its `probes` closest neighbouring cells.

    A row has one or more blocks of 8 coordinates, each decoded for itself; a neighbouring
    cell differs in one block by one of `moves`. `seed` are odd numbers, one for each
    coordinate, and a first one for the table. Shape: rows x (1 + probes).
    """
    n, blocks = len(points), points.shape[1] // DIMENSIONS
    parts = points.reshape(n * blocks, DIMENSIONS)
    own = nearest(parts)
    gain = ((parts - own) @ moves.T).reshape(n, blocks * len(moves))  # the larger, the closer
    best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), np.int64)
    factors = seed[1:].reshape(blocks, DIMENSIONS)
    # coordinates are multiples of 1/2; sums of products modulo 2**64 make a step a single addition
    doubled = (2 * own).astype(np.int64).view(np.uint64).reshape(n, blocks, DIMENSIONS)
    base = (doubled * factors).sum(axis=(1, 2), dtype=np.uint64) + seed[0]
    step = (2 * moves).astype(np.int64).view(np.uint64)
    steps = (step[None, :, :] * factors[:, None, :]).sum(axis=2, dtype=np.uint64).ravel()
    return mixed(np.concatenate([base[:, None], base[:, None] + steps[best]], axis=1))
