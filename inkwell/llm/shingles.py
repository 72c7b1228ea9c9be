"""Word-shingle sets of documents as sorted arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Words whose hashes a task remembers; rows of a batch that it works on at once.
REMEMBER, ROWS = 250_000, 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of bounded rows, so that what is unpacked of them at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], known: WordHashes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted; with fewer words the whole sequence is one; without words, none.

    Bytes A-Z are lowered; words are what white space (bytes 9 to 13 and 32) separates.
    """
    for text in texts:
        tokens = text.translate(LOWER).split() if text else []
        n = len(tokens)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, n)
        size = min(n, width)
        m = n - size + 1
        acc = np.full(m, size, np.uint64)
        for j in range(size):
            acc = acc * _ODD + h[j : j + m]
            acc ^= acc >> np.uint64(29)
        acc = mix(acc)
        acc.sort()
        yield acc[np.concatenate(([True], acc[1:] != acc[:-1]))] if m > 1 else acc
