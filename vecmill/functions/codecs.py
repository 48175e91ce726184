"""Reduced-precision codecs: FP16, FP8 (E4M3), FP4 (E2M1 in blocks of 16)."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: the magnitudes of a nibble.
FP4_LEVELS = np.array([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0])


def fp8_encode(x: np.ndarray) -> np.ndarray:
    """Sign, 4 bits of exponent (bias 7), 3 of mantissa; halves round up, 448 and more saturate."""
    x = np.asarray(x, dtype=np.float64)
    sign, mag = np.signbit(x).astype(np.uint8) << 7, np.abs(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        exponent = np.floor(np.log2(np.where((mag > 0) & np.isfinite(mag), mag, 1.0)))
        # log2 may round up just below a power of two
        exponent = np.where(np.exp2(exponent) > mag, exponent - 1, exponent)
        mantissa = np.floor((mag / np.exp2(exponent) - 1) * 8 + 0.5)
    up = mantissa >= 8
    exponent, mantissa = np.where(up, exponent + 1, exponent), np.where(up, 0, mantissa)
    normal = (exponent + 7) * 8 + mantissa
    small = np.minimum(np.floor(mag * 512 + 0.5), 7)
    with np.errstate(invalid="ignore"):
        code = np.where(mag < 2.0**-6, np.where(mag < 2.0**-10, 0, small), np.minimum(normal, 0x7E))
        code = np.where(mag >= 448, 0x7E, code)
    return np.where(np.isnan(x), 0x7F, code).astype(np.uint8) | sign


_CODES = np.arange(256)
_E, _M = (_CODES >> 3) & 15, _CODES & 7
FP8_TABLE = np.where(_CODES & 128, -1.0, 1.0) * np.where(_E == 0, _M / 512.0, (1 + _M / 8.0) * np.exp2(_E - 7.0))
FP8_TABLE[[127, 255]] = np.nan


def fp8_decode(codes: np.ndarray) -> np.ndarray:
    return FP8_TABLE[np.asarray(codes, dtype=np.uint8)]


def fp4_nibble(x: np.ndarray) -> np.ndarray:
    """The nearest level, ties to the smaller; bit 3 is the sign."""
    mag = np.abs(x)
    cuts = (FP4_LEVELS[1:] + FP4_LEVELS[:-1]) / 2
    return np.searchsorted(cuts, mag, side="left").astype(np.uint8) | (np.signbit(x).astype(np.uint8) << 3)


def fp4_encode(x: np.ndarray) -> np.ndarray:
    """(n, D) as (n, ceil(D / 16) * 9) bytes: an FP8 scale (largest magnitude / 6), then pairs, even dimension low."""
    n, d = x.shape
    wide = np.zeros((n, -(-d // 16), 16))
    wide.reshape(n, -1)[:, :d] = x
    scale = np.abs(wide).max(axis=2) / 6
    nibbles = fp4_nibble(np.divide(wide, scale[..., None], out=np.zeros_like(wide), where=scale[..., None] > 0))
    pairs = nibbles[..., 0::2] | (nibbles[..., 1::2] << 4)
    return np.concatenate([fp8_encode(scale)[..., None], pairs], axis=2).reshape(n, -1)


def fp4_decode(raw: np.ndarray, dim: int) -> np.ndarray:
    blocks = np.asarray(raw, dtype=np.uint8).reshape(len(raw), -1, 9)
    nibbles = np.stack([blocks[..., 1:] & 15, blocks[..., 1:] >> 4], axis=3).reshape(len(raw), blocks.shape[1], 16)
    values = np.where(nibbles & 8, -1.0, 1.0) * FP4_LEVELS[nibbles & 7] * fp8_decode(blocks[..., 0])[..., None]
    return values.reshape(len(raw), -1)[:, :dim]


def encode(x: np.ndarray, mode: str) -> np.ndarray | None:
    if mode == "none":
        return None
    if mode == "fp16":
        return np.ascontiguousarray(x, dtype="<f2").view(np.uint8)
    return fp8_encode(x) if mode == "fp8" else fp4_encode(np.asarray(x, dtype=np.float64))


def decode(raw: np.ndarray, mode: str, dim: int) -> np.ndarray:
    if mode == "fp16":
        return np.ascontiguousarray(raw).view("<f2").astype(np.float64)
    return fp8_decode(raw) if mode == "fp8" else fp4_decode(raw, dim)
