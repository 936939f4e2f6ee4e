"""Prefix polynomial hashes over bytes, modulo 2**64, on whole arrays at once.

The hash of `data[s : s + n]` is the sum of (byte + 1) * BASE**i over the piece's own
positions i. With sums over all prefixes it costs one subtraction and one product, for any
number of pieces at a time. Equal hashes are no proof: whoever relies on them compares bytes.
"""

import numpy as np

BASE = 0x9E3779B97F4A7C55  # odd, so that its powers can be divided out


def mixed(x):
    """Spreads every bit of 64-bit numbers over all bits; one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base, n):
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


class Prefixes:
    def __init__(self, data, powers):
        n = len(data)
        up, self.down = powers.upto(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start, length):
        """Hashes of the pieces that start at `start` (array) and have `length` bytes."""
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def grams(self, k):
        """Mixed hashes of all pieces of k bytes, by start."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1])
