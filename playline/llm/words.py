"""Words of texts as 128-bit hashes, without making a Python object of a short word.

Words are maximal runs outside the six ASCII white-space bytes. A hash has two
halves of 64 bits. Up to LONG bytes they are chains over eight bytes at a time, each
step a different bijection that spreads every bit; longer words take xxh3-128 of
their bytes. Neither is a polynomial, whose equal values for different words
(Thue-Morse words and their complements) can be written down."""

from __future__ import annotations

import numpy as np
import xxhash

SEGMENT = 1 << 21       # bytes whose words are hashed at a time
LONG = 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors for the places of a word in a window.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: For each half: start, factor and step constants.
_START, _ODD, _STEP = mix(np.arange(2, 8, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).reshape(3, 2) | np.uint64(1)
_OTHER = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes [2, words]) of the words of one segment."""
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
    first = eight[start] & _MASK[np.minimum(size, 8)]
    n = size.astype(np.uint64)
    out = np.stack([mix((first ^ _START[k]) * _ODD[k] + n * _STEP[k]) for k in (0, 1)])
    for at in range(8, LONG, 8):
        some = np.flatnonzero(size > at)
        if not len(some):
            break
        more = eight[start[some] + at] & _MASK[np.minimum(size[some] - at, 8)]
        for k in (0, 1):
            out[k, some] = mix((out[k, some] ^ more) * _ODD[k] + _STEP[k])
    for i in np.flatnonzero(size > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[i]:start[i] + size[i]].tobytes())
        out[:, i] = whole >> 64, whole & (1 << 64) - 1
    return start, out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(both halves of the hash of every word [2, words], number of words of each text)."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, hashes = [np.empty(0, dtype=np.int64)], [np.empty((2, 0), dtype=np.uint64)]
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # never cut a word
            gap = np.flatnonzero(_SPACE[data[end:end + 65536]])
            end = end + int(gap[0]) if len(gap) else min(end + 65536, len(data))
        s, h = _segment(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    after = np.searchsorted(start, np.cumsum(size))
    return np.concatenate(hashes, axis=1), np.diff(after, prepend=0)


def windows(a: np.ndarray, width: int, half: int = 0) -> np.ndarray:
    """One half of the hash of every ``width`` consecutive words; ``a``: that half of their hashes."""
    n = max(0, len(a) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h += a[k:k + n] * (FACTORS, _OTHER)[half][k]
    return mix(h)


def few(a: np.ndarray, half: int = 0) -> np.ndarray:
    """One half of the hash of a text of at most 64 words as one window, told apart from windows of other widths."""
    return mix((a * (FACTORS, _OTHER)[half][:len(a)]).sum(keepdims=True) + np.uint64(len(a)))
