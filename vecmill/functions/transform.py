"""Seeded, norm-preserving rotation and sign quantisation (NumPy)."""

from __future__ import annotations

import numpy as np


def rademacher_signs(dim: int, seed: int = 42) -> np.ndarray:
    """+1 and -1 by a 48-bit linear congruential generator's top bit; a prefix for any larger ``dim``."""
    # fixed values of the generator
    multiplier, increment, mask = 0x5DEECE66D, 0xB, (1 << 48) - 1
    state, out = (seed ^ multiplier) & mask, np.empty(dim)
    for i in range(dim):
        state = (state * multiplier + increment) & mask
        out[i] = 1.0 if state >> 47 else -1.0
    return out


def cosine_basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix."""
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.sqrt(2.0 / n) * np.cos(np.pi * i * (2 * j + 1) / (2.0 * n))
    out[0] = 1 / np.sqrt(n)
    return out


def butterfly(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of the second axis of (n, 2^k, m): k passes of sums and differences."""
    n, size, m = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half, m)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, size, m) / np.sqrt(size)


class Rotation:
    """z = H (x * signs), H block-diagonal with one block for each tier.

    A block is Hadamard over the power of two in its width, cosines over the odd
    rest. No matrix is kept but the cosines of the odd parts.
    """

    def __init__(self, dim: int, tiers: list[int], signs: np.ndarray | None = None):
        if signs is not None and len(signs) != dim:
            raise ValueError(f"{dim} signs are needed")
        if not tiers or len(tiers) > 8 or any(b <= a for a, b in zip([0, *tiers], tiers)) or tiers[-1] > dim:
            raise ValueError("1 to 8 tiers are needed, increasing, up to the dimension")
        self.dim, self.tiers = dim, list(tiers)
        self.signs = rademacher_signs(dim) if signs is None else np.asarray(signs, dtype=float)
        odd = {w // (w & -w) for w in np.diff([0, *self.tiers]).tolist()} - {1}
        self._cosines = {w: cosine_basis(w) for w in odd}

    def _turned(self, x: np.ndarray, back: bool) -> np.ndarray:
        out, start = x.copy(), 0
        for end in self.tiers:
            width = end - start
            even = width & -width
            part = x[:, start:end].reshape(len(x), even, width // even)
            if even < width:
                basis = self._cosines[width // even]
                part = part @ (basis if back else basis.T)
            out[:, start:end] = butterfly(part).reshape(len(x), width)
            start = end
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._turned(np.asarray(x, dtype=np.float64) * self.signs, False)

    def invert(self, z: np.ndarray, legacy: bool = False) -> np.ndarray:
        """By the transpose; ``legacy`` applies H again, an inverse only if all blocks are powers of two."""
        return self._turned(np.asarray(z, dtype=np.float64), not legacy) * self.signs


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(n, D) booleans as (n, ceil(D / 64)) longs, least bit first."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), dtype=bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<i8")


def unpack_bits(words: np.ndarray, dim: int) -> np.ndarray:
    raw = np.ascontiguousarray(words, dtype="<i8").view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :dim].astype(bool)


def thresholds(z: np.ndarray, share: float = 0.20) -> np.ndarray:
    """For each row, the value of |z| at position int(D * share) in ascending order."""
    d = z.shape[1]
    return np.sort(np.abs(z), axis=1)[:, min(d - 1, int(np.float32(d) * np.float32(share)))]


def quantise(z: np.ndarray, bits: int = 1) -> tuple[np.ndarray, np.ndarray | None]:
    """Sign words; with 2 bits, also mask words of the components at or over the row's threshold."""
    if bits == 1:
        return pack_bits(z >= 0), None
    mask = np.abs(z) >= thresholds(z)[:, None]
    return pack_bits((z >= 0) & mask), pack_bits(mask)


def spectral_energy(weights: np.ndarray) -> np.ndarray:
    """Cumulative share of the squared singular values of a (D, r) matrix, for 1 to D of them."""
    values = np.sort(np.clip(np.linalg.eigvalsh(weights @ weights.T), 0, None))[::-1]
    total = values.sum()
    return np.cumsum(values) / total if total > 0 else np.ones(len(values))


def tier_for(energy: list[float], budget: float = 0.90) -> int:
    """The first tier whose energy reaches the budget; the last if none does."""
    if not 0 < budget <= 1:
        raise ValueError("a budget lies in (0, 1]")
    return next((i for i, e in enumerate(energy) if e >= budget), len(energy) - 1)
