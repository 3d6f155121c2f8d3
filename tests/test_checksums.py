"""CRC-32 over arrays against zlib."""

import zlib

import numpy as np
import pytest

from shelfmark.functions import checksums


@pytest.mark.parametrize("most", [0, 3, 9, 300, 5000])
def test_many_values(most):
    rng = np.random.default_rng(most)
    data = rng.integers(0, 4 if most < 9 else 256, 20_000).astype(np.uint8)
    lengths = rng.integers(0, most + 1, 400)
    starts = rng.integers(0, len(data) - most, 400)
    raw = data.tobytes()
    assert checksums.crc32s(data, starts, lengths).tolist() == [zlib.crc32(raw[s:s + n]) for s, n in zip(starts, lengths)]


def test_widths_around_the_cut():
    data = np.arange(5000, dtype=np.uint32).astype(np.uint8)
    for n in (255, 256, 257, 258, 260, 511, 512, 513, 4096):
        assert checksums.crc32s(data, np.array([3]), np.array([n])).tolist() == [zlib.crc32(data[3:3 + n].tobytes())]


@pytest.mark.parametrize("parts", [[], [b""], [b"", b"abc", b""], [b"a" * 70_000, b"b", b"c" * 999], [bytes(range(256)) * 9] * 5])
def test_joined(parts):
    assert checksums.joined([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))
