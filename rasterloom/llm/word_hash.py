"""64-bit hashes of all words of a batch of texts at once, on the bytes of the Arrow column.

Words are runs of bytes outside [\\x20\\x09-\\x0D] with A-Z taken as a-z; both rules touch ASCII
only, so bytes and characters agree. A word of up to LANES lanes of eight bytes is mixed lane by
lane, all words at once; a longer one has a digest of its own. Neither is a polynomial of the bytes,
so no family of words is bound to collide: two words share a hash with probability about 2**-64.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed together; a longer text is taken alone.
SPAN = 1 << 20
#: Lanes of eight bytes up to which a word is mixed in NumPy.
LANES = 8


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case, and which bytes end a word."""
    lower = np.arange(256, dtype="u1")
    lower[65:91] = lower[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return lower, space


def _hash_span(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in raw and the number of words in each text; starts are the texts' edges in raw."""
    lower, space = _tables()
    blank = space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[True], blank[:-1]]) | edge[:-1]
    after = np.concatenate([blank[1:], [True]]) | edge[1:]
    first, size = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    size -= first
    plain = np.concatenate([lower[raw], np.zeros(8, "u1")])
    lanes = np.ndarray(len(raw) + 1, "<u8", plain, strides=(1,))  # the eight bytes from each place
    h = mix(size.astype("u8"))
    open_ = np.arange(len(first))
    for k in range(LANES):
        left = size[open_] - 8 * k
        open_ = open_[left > 0]
        if not len(open_):
            break
        left = left[left > 0]
        lane = lanes[first[open_] + 8 * k]
        cut = left < 8
        lane[cut] &= (np.uint64(1) << (8 * left[cut]).astype("u8")) - np.uint64(1)
        h[open_] = mix(h[open_] + lane)
    for i in np.flatnonzero(size > 8 * LANES):
        h[i] = int.from_bytes(hashlib.blake2b(plain[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(first, starts[1:]) - np.searchsorted(first, starts[:-1])


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); nulls have none."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    buffers = column.buffers()
    edges = np.frombuffer(buffers[1], "i8")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(buffers[2], "u1") if buffers[2] is not None else np.zeros(0, "u1")
    hashes, counts, at = [], [], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SPAN, "right")) - 1)
        to = min(to, len(column))
        h, n = _hash_span(raw[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
        hashes.append(h)
        counts.append(n)
        at = to
    return np.concatenate(hashes), np.concatenate(counts)
