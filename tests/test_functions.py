import numpy as np
import pytest

from vecmill.functions import codecs
from vecmill.functions.transform import Rotation, cosine_basis, pack_bits, quantise, rademacher_signs, spectral_energy, tier_for, unpack_bits


def test_signs_are_the_known_ones():
    known = "+-+--+-++-+----+-++++---++-+--+---+---+-+++-+-++----+--++-++-+--"
    assert "".join("+" if s > 0 else "-" for s in rademacher_signs(64)) == known
    assert (rademacher_signs(100)[:64] == rademacher_signs(64)).all()


@pytest.mark.parametrize("dim,tiers", [(64, [64]), (128, [32, 64, 96, 128]), (96, [96]), (12, [12])])
def test_rotation_keeps_norms_and_inverts(dim, tiers):
    x = np.random.default_rng(0).normal(size=(50, dim))
    r = Rotation(dim, tiers)
    z = r.apply(x)
    assert np.allclose((z**2).sum(1), (x**2).sum(1))
    assert np.allclose(r.invert(z), x)


def test_rotation_is_its_matrix():
    for dim, tiers in ((64, [64]), (96, [32, 96]), (100, [10, 48, 90]), (7, [7])):
        whole, start = np.eye(dim), 0
        for end in tiers:
            w = end - start
            even = w & -w
            i = np.arange(even)
            signs = (1.0 - 2.0 * (np.bitwise_count(i[:, None] & i[None, :]) & 1)) / np.sqrt(even)
            whole[start:end, start:end] = np.kron(signs, cosine_basis(w // even)) if even < w else signs
            start = end
        r, x = Rotation(dim, tiers), np.random.default_rng(7).normal(size=(9, dim))
        assert np.allclose(r.apply(x), (x * r.signs) @ whole.T)
        assert np.allclose(r.invert(x, legacy=True), (x @ whole.T) * r.signs)
    own = np.where(np.arange(8) % 3 == 0, -1.0, 1.0)
    assert np.allclose(Rotation(8, [8], own).apply(np.eye(8)), Rotation(8, [8], np.ones(8)).apply(np.diag(own)))
    with pytest.raises(ValueError):
        Rotation(8, [8], own[:7])


@pytest.mark.parametrize("tiers", [[], [0], [8, 8], [16, 8], [200], list(range(1, 10))])
def test_bad_tiers(tiers):
    with pytest.raises(ValueError):
        Rotation(128, tiers)


def test_bits():
    bits = np.random.default_rng(1).random((20, 100)) < 0.5
    assert (unpack_bits(pack_bits(bits), 100) == bits).all()
    z = np.random.default_rng(2).normal(size=(20, 100))
    signs, mask = quantise(z, 2)
    kept = unpack_bits(mask, 100)
    assert (kept.sum(1) == 80).all()
    assert (unpack_bits(signs, 100) == ((z >= 0) & kept)).all()


def test_fp8():
    table = codecs.FP8_TABLE
    fine = ~np.isnan(table)
    assert (codecs.fp8_decode(codecs.fp8_encode(table[fine])) == table[fine]).all()
    x = np.array([0, 1, -1, 0.5, -0.5, 2.0**-9, 448, -448, 500, -600, np.inf, 15.9999])
    assert np.allclose(codecs.fp8_decode(codecs.fp8_encode(x)), [0, 1, -1, 0.5, -0.5, 2.0**-9, 448, -448, 448, -448, 448, 16])
    assert np.isnan(codecs.fp8_decode(codecs.fp8_encode(np.array([np.nan]))))[0]


def test_fp4_and_fp16():
    levels = np.concatenate([codecs.FP4_LEVELS, -codecs.FP4_LEVELS])
    x = np.tile(levels, (3, 2))[:, :30]
    assert np.allclose(codecs.fp4_decode(codecs.fp4_encode(x), 30), x)
    assert codecs.fp4_encode(x).shape == (3, 18)
    assert (codecs.fp4_nibble(np.array([0.25, 0.75, 5.0])) == [0, 1, 6]).all()  # ties to the smaller
    y = np.random.default_rng(3).normal(size=(4, 8))
    assert np.allclose(codecs.decode(codecs.encode(y, "fp16"), "fp16", 8), y, rtol=1e-3)


def test_energy():
    assert np.allclose(spectral_energy(np.diag([2, 1, 0.5, 0])), [0.7619, 0.9523, 1, 1], atol=1e-3)
    assert tier_for([0.5, 0.95], 0.9) == 1 and tier_for([0.5, 0.6], 0.9) == 1
    with pytest.raises(ValueError):
        tier_for([1.0], 0)
