import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators.coders import CODERS, choose, huffman, rans, zero_tile
from tesserae.operators.coders.common import band_map, read_varint, varint

rng = np.random.default_rng(7)
TILES = {
    "zero": np.zeros(64 * 64, int),
    "sparse": np.where(rng.random(64 * 64) < 0.9, 0, rng.integers(-30, 31, 64 * 64)),
    "dense": np.rint(rng.laplace(0, 8, 64 * 64)).astype(int),
    "wide": rng.integers(-1500, 1500, 64 * 64),
    "few": np.eye(64, dtype=int).ravel() * -3,
}


@pytest.mark.parametrize("coder", sorted(CODERS))
@pytest.mark.parametrize("tile", sorted(TILES))
def test_round_trip(coder, tile):
    blob = CODERS[coder][1](TILES[tile], 64, 3)
    assert (CODERS[coder][2](blob) == TILES[tile]).all()


@pytest.mark.parametrize("tile", sorted(TILES))
def test_context_round_trip(tile):
    assert (rans.decode_context(rans.encode_context(TILES[tile], 64, 3)) == TILES[tile]).all()


@given(st.lists(st.integers(-300, 300), max_size=200))
@settings(max_examples=40, deadline=None)
def test_single_stream(values):
    assert rans.decode_single(rans.encode_single(np.array(values, int))).tolist() == values


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=300).filter(any))
@settings(max_examples=60, deadline=None)
def test_normalized_frequencies(counts):
    freq = rans.normalize(np.array(counts))
    assert freq.sum() == rans.TOTAL
    assert all((f > 0) == (c > 0) for f, c in zip(freq, counts, strict=True))


@given(st.lists(st.integers(0, 1 << 20), min_size=64, max_size=64).filter(any))
@settings(max_examples=60, deadline=None)
def test_code_lengths_satisfy_kraft(freq):
    lengths = huffman.code_lengths(freq)
    assert all((n > 0) == (f > 0) for n, f in zip(lengths, freq, strict=True))
    assert max(lengths) <= huffman.LONGEST
    assert sum(2.0**-n for n in lengths if n) <= 1
    words = [w for w in huffman.codes(lengths) if w]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


@given(st.lists(st.sampled_from([0, 0, 0, 1, -2]), max_size=2000))
@settings(max_examples=30, deadline=None)
def test_zero_runs(values):
    assert rans.without_runs(rans.with_runs(values, 3), 3) == values


def test_varints_and_bands():
    for v, n in ((127, 1), (128, 2), (300, 2), (16383, 2), (16384, 3), (65535, 3)):
        assert len(varint(v)) == n and read_varint(varint(v), 0) == (v, n)
    m = band_map(8, 2).reshape(8, 8)
    assert [m[y, x] for x, y in ((0, 0), (2, 0), (0, 2), (3, 3), (5, 0), (0, 5), (5, 5))] == [0, 1, 1, 1, 2, 2, 3]


def test_choice_and_zero_tiles():
    assert choose("rans", True) == "rans_bands" and choose("rice", True) == "rice"
    for coder in CODERS:
        assert not CODERS[coder][2](zero_tile(coder, 64, 3)).any()
