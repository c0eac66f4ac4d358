"""Words of whole Arrow batches as NumPy arrays: boundaries and 64-bit hashes without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Multipliers of the SplitMix64 finaliser.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space only, and everything in ASCII but letters and digits.
BREAKS = {"space": _SPACE, "symbol": np.array([b < 128 and not chr(b).isalnum() for b in range(256)])}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Random weights of the byte positions of a word.
_WEIGHTS = np.random.default_rng(20240229).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes of all texts
    starts: np.ndarray  #: of words, in data
    ends: np.ndarray
    first: np.ndarray  #: of each text's words, with one more entry for the end
    hashes: np.ndarray  #: uint64, equal for equal words

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def batches_of(texts: pa.Array, most: int = 1 << 18):
    """Cuts an array of texts into runs of about `most` bytes, one text at least."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, stop
        at = stop


def words(texts: pa.Array, breaks: str = "space") -> Words:
    """Null texts have no words. ASCII letters are lower-cased; other bytes stay."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # offsets from 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = _LOWER[raw]
    inner = ~BREAKS[breaks][data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inner[cut]  # a text's first byte never continues the text before
    stops = inner.copy()
    stops[:-1] &= ~inner[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    lens = ends - starts
    if len(lens):
        before = np.concatenate([[0], np.cumsum(lens)[:-1]])
        at = np.arange(int(lens.sum())) - np.repeat(before, lens)
        with np.errstate(over="ignore"):
            hashes = mix(np.add.reduceat((data[inner].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[at & 1023], before) + lens.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, starts, ends, first, hashes)


def windows(hashes: np.ndarray, mask: list[int]) -> np.ndarray:
    """A hash for each window of the mask's length, over the positions where the mask is 1."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    with np.errstate(over="ignore"):
        for i, used in enumerate(mask):
            if used:
                out = (out ^ hashes[i : i + n]) * MIX1
                out ^= out >> np.uint64(29)
    return mix(out)
