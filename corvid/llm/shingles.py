"""Word shingles of texts as 64-bit hashes, computed in numpy over many texts at once.

Words are the runs of bytes that are not space, tab, line feed, vertical tab, form
feed or carriage return; A-Z count as a-z.  A word's hash is a polynomial over its
bytes, taken from prefix sums; a shingle's hash mixes the hashes of ``k``
consecutive words.  A text with fewer words than ``k`` is one shingle, its whole
sequence; a text without words (or a null one) has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed at once; a longer word is hashed in one go all the same.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE[0x20] = 0
_MULT = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        for base in (_BASE, inverse):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row, dtype=np.uint64))
    return _powers[0], _powers[1]


def fold(text: bytes) -> bytes:
    """Lower-case A-Z, every white space a space."""
    return text.translate(_FOLD)


def _word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a folded text, and where each starts."""
    raw = np.frombuffer(folded, dtype=np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = _tables(n)
    solid = raw != 0x20
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    value = _BYTE[raw] * power[:n]
    run = np.cumsum(value)
    return mix64((run[end - 1] - run[start] + value[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _segments(folded: bytes) -> Iterator[bytes]:
    at = 0
    while len(folded) - at > SEGMENT:
        cut = folded.rfind(b" ", at, at + SEGMENT)
        if cut <= at:
            cut = folded.find(b" ", at + SEGMENT)
        if cut < 0:
            break
        yield folded[at:cut]
        at = cut
    yield folded[at:]


def words_of(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _word_hashes(b" ".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(hashes, np.searchsorted(starts, ends)[:-1]) if held else ()

    for text in texts:
        folded = fold(text or b"")
        if size + len(folded) > SEGMENT and held:
            yield from flush()
            held, size = [], 0
        if len(folded) > SEGMENT:
            yield np.concatenate([_word_hashes(s)[0] for s in _segments(folded)])
            continue
        held.append(folded)
        size += len(folded) + 1
    if held:
        yield from flush()


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all shingles of a word sequence, in order, repeats included."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out += words[i : n - width + 1 + i] * _MULT[i]
    return mix64(out)


def shingle_sets(texts: Iterable[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in words_of(texts):
        yield np.unique(shingle_hashes(words, k))
