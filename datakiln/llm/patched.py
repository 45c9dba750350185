"""Token ids in patched frame-of-reference blocks: the bytes of one file.

A block holds `BLOCK` ids (the last of a file may hold fewer).  Its smallest id is
subtracted; the rest is packed at the width that `PERCENTILE` of the block's numbers fit;
those that do not fit leave their low bits in place and their high bits in an exception
list.  All numbers are little-endian:

* file: `MAGIC`, blocks, block starts (uint64 each), doc ids (int64 each), whether they are
  known (one byte each), places of the documents' first ids in the file and the end (uint64
  each), then ids, blocks, documents (uint64) and `MAGIC`;
* block: smallest id (uint32), width and number of exceptions (one byte each), packed
  numbers, places of the exceptions (one byte each), their high bits (uint32 each).

The index of block starts lets a reader decode the blocks of some ids alone.
"""

from dataclasses import dataclass

import numpy as np

from datakiln.llm.bitpack import bit_length, pack, packed_size, unpack

MAGIC = b"PFORIDS1"
BLOCK, PERCENTILE = 128, 0.9
#: Blocks that are encoded at once.
BLOCKS_AT_ONCE = 4096
_HEAD, _TAIL = 6, 24 + len(MAGIC)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Ids below 2 ** 32 as blocks."""
    step = BLOCK * BLOCKS_AT_ONCE
    return [block for at in range(0, len(ids), step) for block in encode_some(ids[at : at + step])]


def encode_some(ids: np.ndarray) -> list[bytes]:
    """As many ids as are encoded at once."""
    n = len(ids)
    whole = np.full(-(-n // BLOCK) * BLOCK, ids[-1], np.uint32)
    whole[:n] = ids
    values = whole.reshape(-1, BLOCK)
    low = values.min(axis=1)
    deltas = values - low[:, None]
    width = bit_length(np.partition(deltas, int(PERCENTILE * BLOCK) - 1, axis=1)[:, int(PERCENTILE * BLOCK) - 1])
    high = (deltas.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    patched = high > 0
    count = patched.sum(axis=1)
    bodies: list[bytes] = [b""] * len(values)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        rows = pack(deltas[mine] & np.uint32((1 << w) - 1), w)
        for i, row in zip(mine.tolist(), rows, strict=True):
            bodies[i] = row.tobytes()
    places = np.nonzero(patched)[1].astype(np.uint8).tobytes()
    highs = high[patched].astype("<u4").tobytes()
    heads = np.empty(len(values), np.dtype([("low", "<u4"), ("width", "u1"), ("count", "u1")]))
    heads["low"], heads["width"], heads["count"] = low, width, count
    heads_bytes, out, at = heads.tobytes(), [], 0
    for i, k in enumerate(count.tolist()):
        out.append(heads_bytes[_HEAD * i : _HEAD * i + _HEAD] + bodies[i] + places[at : at + k] + highs[4 * at : 4 * (at + k)])
        at += k
    return out


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray) -> bytes:
    """A file of the ids of some documents; ``starts`` has the place of each document's first id, and the end."""
    blocks = encode_blocks(ids)
    offsets = len(MAGIC) + np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)[:-1]]) if blocks else np.empty(0)
    counts = np.array([len(ids), len(blocks), len(doc_ids)], "<u8")
    return b"".join([MAGIC, *blocks, offsets.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), counts.tobytes(), MAGIC])


@dataclass(frozen=True)
class TokenFile:
    """The index of a file and its bytes."""

    data: np.ndarray
    offsets: np.ndarray
    doc_ids: np.ndarray
    known: np.ndarray
    starts: np.ndarray
    n_ids: int

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop, from their blocks alone."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        return decode_blocks(self.data, self.offsets[first:last])[start - first * BLOCK : stop - first * BLOCK]


def open_file(content: bytes) -> TokenFile:
    """A file's index; an error if it is cut short or another kind."""
    if len(content) < len(MAGIC) + _TAIL or content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a whole file of token blocks")
    n_ids, blocks, docs = np.frombuffer(content[-_TAIL : -len(MAGIC)], "<u8").tolist()
    at = len(content) - _TAIL - 8 * blocks - 9 * docs - 8 * (docs + 1)
    parts = []
    for kind, count in (("<i8", blocks), ("<i8", docs), ("u1", docs), ("<i8", docs + 1)):
        parts.append(np.frombuffer(content, kind, count, at))
        at += parts[-1].nbytes
    return TokenFile(np.frombuffer(content, np.uint8), *parts, n_ids)


def decode_blocks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of the blocks at these offsets, the last one filled up to `BLOCK`."""
    heads = data[offsets[:, None] + np.arange(_HEAD)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    width, count = heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    out = np.empty((len(offsets), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        out[mine] = unpack(data[(offsets[mine] + _HEAD)[:, None] + np.arange(packed_size(BLOCK, w))], BLOCK, w)
    row = np.repeat(np.arange(len(offsets)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = (offsets + _HEAD + (BLOCK * width + 7) // 8)[row]
    place = data[begin + nth]
    high = data[(begin + count[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(row) else np.empty(0, np.uint32)
    out[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (out + low[:, None]).ravel()
