"""Words of many texts at once: numpy finds class runs in the joined UTF-8 bytes and hashes each run.

A run is a maximal stretch of letters (every byte of a non-ASCII character counts as a letter), of one
digit or of digits, or of other visible characters. Nothing is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = LETTER

_BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, _WORD))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, salted."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % _WORD)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] = sum of (byte + 1) * base**k over k < i, modulo 2**64: for rolling hashes of short windows only."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def rolling_hash(data: np.ndarray, window: int) -> np.ndarray:
    """The hash of each ``window`` bytes; equal windows have equal hashes, but who confirms nothing must not trust them."""
    sums = prefix_sums(data)
    return mix((sums[window:] - sums[:-window]) * _power_tables(len(sums))[1][: len(sums) - window])


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LONG = 256  # bytes


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def first_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the first n (at most eight) of eight bytes."""
    return _KEEP[np.minimum(n, 8)]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes wherever they stand. Spans of at most seven bytes never share one."""
    at, size = eights(data), end - start
    first = at[start] & first_bytes(size)
    h = mix(first | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56)))
    some = np.flatnonzero(size > 7)
    if len(some):
        h[some] = mix(size[some].astype(np.uint64), 9)
    todo = some[size[some] <= LONG]
    place = 0
    while len(todo):
        block = at[start[todo] + place] & first_bytes(size[todo] - place)
        h[todo] = mix(h[todo] ^ block, 1)
        place += 8
        todo = todo[size[todo] > place]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    return h


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one line feed after each
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    doc: np.ndarray  # text number of each run
    bounds: np.ndarray  # runs of text d are bounds[d]:bounds[d + 1]
    edges: np.ndarray  # bytes of text d are edges[d]:edges[d + 1] - 1

    @property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)

    def only(self, keep: np.ndarray) -> "Words":
        kept = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        return Words(self.data, self.start[keep], self.end[keep], self.kind[keep], self.doc[keep], kept[self.bounds], self.edges)


def words(texts: list[str | None], lone_digits: bool = False, join_alnum: bool = False) -> Words:
    """Runs of the texts as they stand (lower-case them first where case should not count).

    lone_digits: each digit is a run of its own. join_alnum: letters and digits form common runs.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    edges = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=edges[1:])
    kind = _CLASS[data]
    if join_alnum:
        kind = np.where(kind == DIGIT, np.uint8(LETTER), kind)
    change = np.ones(len(data) + 1, bool)
    if len(data):
        change[1:-1] = kind[1:] != kind[:-1]
        if lone_digits:
            change[:-1] |= kind == DIGIT
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    visible = kind[start] != SPACE if len(data) else np.zeros(0, bool)
    start, end = start[visible], end[visible]
    bounds = np.searchsorted(start, edges)
    doc = np.repeat(np.arange(len(raw)), np.diff(bounds))
    return Words(data, start, end, kind[start] if len(data) else np.zeros(0, np.uint8), doc, bounds, edges)


def by_bytes(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    first = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t or "") > limit:
            yield first, k
            first, total = k, 0
        total += len(t or "") + 1
    if first < len(texts):
        yield first, len(texts)
