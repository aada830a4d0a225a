"""Words of many texts at once, as hash terms with their byte ranges.

A word is a run of Unicode word characters (``\\w``) of the text in lower case: texts with other than
ASCII characters are put in lower case, and their non-ASCII characters outside words become blanks,
before bytes are looked at.  Words are hashed by sums of byte codes times powers of an odd number modulo 2 ** 64, taken
from one running sum over the bytes, so no text is split in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed in one go.
_AT_ONCE = 1 << 20
_OUTSIDE = re.compile(r"[^\w\x00-\x7f]+")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.random.default_rng(9).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    codes[65:91] = codes[97:123]
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
    codes[~inside] = 0
    return codes, inside


_CODES, _INSIDE = _tables()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd number, and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = max(n, _AT_ONCE + 4096)
        for i, odd in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            factors = np.full(size, odd, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """Terms of all words, their byte ranges in ``data`` (the folded texts), and the number of words of each text."""

    data: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def text(self, first: int, last: int) -> str:
        """The text from one word to before another (numbers over all texts)."""
        return self.data[self.starts[first] : self.ends[last - 1]].tobytes().decode("utf-8", "replace")


def folded(texts: pa.Array) -> pa.Array:
    """The texts with one case and with blanks for non-ASCII characters that are in no word; ASCII texts as they are."""
    other = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(other).as_py():
        return texts
    found = [_OUTSIDE.sub(" ", t.lower()) for t in texts.filter(other).to_pylist()]
    return pc.replace_with_mask(texts, other, pa.array(found, texts.type))


def split(texts: pa.Array, bits: int) -> Words:
    """The words of the texts as terms of so many bits; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = folded(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    edges = edges.astype(np.int64)
    size = int(edges[-1] - edges[0])
    none = np.zeros(0, np.int64)
    if not size:
        return Words(np.zeros(0, np.uint8), none.astype(np.uint16), none, none, np.zeros(len(texts), np.int64))
    body = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    inside = _INSIDE[body]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = edges[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        until = max(at + 1, int(np.searchsorted(ends, first + _AT_ONCE)))
        last = ends[until - 1]
        powers, inverse = _powers(int(last - first) + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_CODES[body[first:last]] * powers[: last - first], out=sums[1:])
        s, e = starts[at:until] - first, ends[at:until] - first
        hashes[at:until] = (sums[e] - sums[s]) * inverse[s]
        at = until
    terms = ((hashes * _SPREAD) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)
    counts = np.diff(np.searchsorted(starts, edges))
    return Words(body, terms, starts, ends, counts)
