"""CRC-32 over arrays: many values at once, and joined from the checksums of parts.

The register behind a CRC-32 is linear over GF(2): zero bytes in front of a value leave an empty register as it is, and
n bytes behind it multiply the register by a 32 x 32 bit matrix. So values of unequal length can share a matrix of
bytes, padded in front, and the checksum of a whole follows from those of its parts and their lengths.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)


def _step(register: np.ndarray) -> np.ndarray:
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(POLYNOMIAL), register >> 1)
    return register


TABLE = _step(np.arange(256, dtype=np.uint32))


def advance(register: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``register`` of every row after the bytes of ``rows`` (n x width, uint8), a column at a time."""
    for column in rows.T:
        register = TABLE[(register ^ column) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


def _times(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The bit matrix with these columns (32 of uint32) times every value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """Columns of the matrix for 2**k zero bytes."""
    if k == 0:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return TABLE[unit & np.uint32(0xFF)] ^ (unit >> np.uint32(8))
    half = _power(k - 1)
    return _times(half, half)


def shifted(register: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Every register after its number of zero bytes."""
    register, n = np.array(register, np.uint32), np.array(n_bytes, np.int64)
    k = 0
    while n.any():
        odd = (n & 1).astype(bool)
        if odd.any():
            register[odd] = _times(_power(k), register[odd])
        n >>= 1
        k += 1
    return register


def joined(checksums: list[int], lengths: list[int]) -> int:
    """CRC-32 of parts one after the other, from the CRC-32 and the length of each."""
    behind = np.append(np.cumsum(np.array(lengths[::-1], np.int64))[::-1][1:], 0) if lengths else np.zeros(0, np.int64)
    return int(np.bitwise_xor.reduce(shifted(np.array(checksums, np.uint32), behind))) if lengths else 0


#: columns of a matrix that long values are cut into
WIDE = 256


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches of ``data`` (uint8) at ``starts``, as ``zlib.crc32`` gives it.

    Stretches of equal length form one matrix of bytes, in which equal rows are looked at once, and all its checksums are
    updated column by column. Stretches beyond ``WIDE`` bytes are cut into rows of that width, with zeros in front.
    """
    import pyarrow as pa

    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for at, to in zip(edges, np.append(edges[1:], len(order))):
        width = int(lengths[order[at]])
        if width > WIDE:
            long = order[at:]
            out[long] = _long(data, starts[long], lengths[long])
            break
        chosen = order[at:to]
        if width == 0:
            continue
        rows = np.ascontiguousarray(data[starts[chosen][:, None] + np.arange(width)])
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(chosen), [None, pa.py_buffer(rows)]).dictionary_encode()
        distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8, len(coded.dictionary) * width).reshape(-1, width)
        sums = advance(np.full(len(distinct), ONES), distinct) ^ ONES
        out[chosen] = sums[coded.indices.to_numpy()]
    return out


def _long(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n_rows = -(-lengths // WIDE)
    first = np.append(0, np.cumsum(n_rows))
    rows = np.zeros(int(first[-1]) * WIDE, np.uint8)
    for start, length, end in zip(starts.tolist(), lengths.tolist(), (first[1:] * WIDE).tolist()):
        rows[end - length:end] = data[start:start + length]
        # all ones at the start of the register count as the first four bytes turned over
        rows[end - length:end - length + 4] ^= 0xFF
    register = advance(np.zeros(int(first[-1]), np.uint32), rows.reshape(-1, WIDE))
    # the matrix of one row's width, as a table for each byte of the register
    bytes_ = np.arange(256, dtype=np.uint32)
    tables = [shifted(bytes_ << np.uint32(8 * i), np.full(256, WIDE)) for i in range(4)]
    state = np.zeros(len(starts), np.uint32)
    for k in range(int(n_rows.max(initial=0))):
        live = np.flatnonzero(n_rows > k)
        s = state[live]
        s = tables[0][s & 0xFF] ^ tables[1][s >> np.uint32(8) & 0xFF] ^ tables[2][s >> np.uint32(16) & 0xFF] ^ tables[3][s >> np.uint32(24)]
        state[live] = s ^ register[first[live] + k]
    return state ^ ONES
