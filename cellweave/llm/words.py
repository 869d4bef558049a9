"""Words of whole record batches as 64-bit hashes, without a Python object a word.

Word boundaries and hashes are computed by numpy on the UTF-8 bytes of an Arrow column.  Two words share a hash with
probability 2^-64 (a polynomial over a table of random numbers, mixed with the length); words of more than ``DIRECT`` bytes are
hashed by XXH64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

DIRECT = 32

_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    hashes: np.ndarray  #: of all texts' words, one after the other
    sizes: np.ndarray  #: words of each text


def hash_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words (runs without white space) of each text, a null text having none; with ``lower``, A-Z are lower-cased first."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(column):
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        return Words(np.empty(0, np.uint64), np.zeros(len(column), np.int64))
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = word[head], word[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(starts, offsets))
    lengths = ends - starts
    short = np.minimum(lengths, DIRECT + 1).astype(np.uint8)
    order = np.argsort(DIRECT + 1 - short, kind="stable")  # longest first
    at = starts[order]
    longer = len(order) - np.cumsum(np.bincount(short, minlength=DIRECT + 2))  # words of more than k bytes
    h = np.zeros(len(order), np.uint64)
    for k in range(DIRECT):
        m = int(longer[k])
        if not m:
            break
        h[:m] = h[:m] * _BASE + _TABLE[data[at[:m] + k]]
    for i in range(int(longer[DIRECT])):
        word_at = order[i]
        h[i] = xxhash.xxh64_intdigest(data[starts[word_at] : ends[word_at]].tobytes(), 7)
    out = np.empty_like(h)
    out[order] = h
    return Words(mix(out ^ (lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))), sizes)
