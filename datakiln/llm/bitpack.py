"""Unsigned numbers packed at a fixed number of bits each, by numpy over many rows at once."""

import numpy as np

#: Bits that are spread out at once, one byte each.
BITS_AT_ONCE = 1 << 22


def bit_length(values: np.ndarray) -> np.ndarray:
    """The bits that each number below 2 ** 53 needs; 0 for 0."""
    return np.frexp(values.astype(np.float64))[1]


def packed_size(count: int, width: int) -> int:
    """Bytes of ``count`` numbers of ``width`` bits."""
    return (count * width + 7) // 8


def room(width: int) -> int:
    """The bits of the number type that holds ``width`` bits."""
    return 16 if width <= 16 else 32


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Each row of (n, m) numbers below 2 ** width as bytes, the lowest bit first."""
    n, m = values.shape
    out = np.empty((n, packed_size(m, width)), np.uint8)
    held = room(width)
    step = max(1, BITS_AT_ONCE // max(m * held, 1))
    for at in range(0, n, step):
        some = np.ascontiguousarray(values[at : at + step], dtype=f"<u{held // 8}")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, held // 8), axis=1, count=width, bitorder="little")
        out[at : at + step] = np.packbits(bits.reshape(len(some), m * width), axis=1, bitorder="little")
    return out


def unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """The reverse of `pack`: (n, bytes) to (n, count) numbers."""
    out = np.zeros((len(data), count), np.uint32)
    if not width:
        return out
    step = max(1, BITS_AT_ONCE // max(count * width, 1))
    for at in range(0, len(data), step):
        bits = np.unpackbits(data[at : at + step], axis=1, count=count * width, bitorder="little").reshape(-1, count, width)
        for i in range(width):
            out[at : at + step] |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
    return out
