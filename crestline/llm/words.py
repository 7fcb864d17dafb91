"""Words of byte buffers and their 64-bit hashes, computed on whole slices at once."""

from __future__ import annotations

import numpy as np

from crestline.llm.base import mix, seeds

_BYTE = seeds(256, 0x5851F42D4C957F2D)
_PLACE = seeds(4096, 0x14057B7EF767814F)
_FAR = seeds(1, 0x369DEA0F31A53F85)[0]
_LENGTH = seeds(1, 0x2545F4914F6CDD1D)[0]
_STEP = seeds(64, 0x27BB2EE687B0B0FD)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a list of UTF-8 texts, laid end to end.

    ``doc`` gives each word's text, ``hash`` a 64-bit value that depends on its
    bytes only, ``first``/``last`` the word range of each text. ``separator``
    marks the bytes that end a word.
    """

    def __init__(self, texts: list[bytes], separator: np.ndarray = SPACES):
        self.n_texts = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lens + 1)
        self.text_start = self.text_end - lens - 1
        inside = ~separator[self.bytes]
        inside[self.text_end - 1] = False
        self.inside = inside
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[0::2], edges[1::2]
        size = self.end - self.start
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)
        self.count = self.last - self.first
        self.doc = np.repeat(np.arange(self.n_texts), self.count)
        if len(size):
            body = self.bytes[inside]
            offset = np.cumsum(size) - size
            place = np.arange(len(body)) - np.repeat(offset, size)
            factor = _PLACE[place & 4095]
            if int(size.max()) > len(_PLACE):  # each further stretch of 4096 bytes shifts the factors
                factor += (place >> 12).astype(np.uint64) * _FAR
            total = np.add.reduceat(_BYTE[body] * factor, offset)
            self.hash = mix(total + size.astype(np.uint64) * _LENGTH)
        else:
            self.hash = np.zeros(0, np.uint64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each position on, and whether they lie in one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += self.hash[j : j + n] * _STEP[j % 64] + _STEP[(j + 17) % 64]
        return mix(total), self.doc[:n] == self.doc[width - 1 :]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of each text, A-Z lower-cased.

    A text of fewer words is one shingle of all its words; one without words
    gives an empty set. Equal word sequences give equal values; two different
    ones share a 64-bit value with a chance of 2**-64.
    """
    w = Words([t.lower() for t in texts])
    h, whole = w.windows(width)
    out = []
    for a, n in zip(w.first.tolist(), w.count.tolist()):
        if n >= width:
            out.append(np.unique(h[a : a + n - width + 1]))
        elif n:
            total = np.sum((w.hash[a : a + n] + _STEP[:n]) * _STEP[n : 2 * n], keepdims=True)
            out.append(mix(total + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
