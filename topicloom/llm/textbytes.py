"""Words and their hashes out of Arrow strings, a block of texts at a time, by array operations on bytes.

White space is ASCII only (blank and 0x09-0x0D), so UTF-8 bytes can be cut without decoding. A word's hash is 64 bits: its bytes
as a polynomial with an odd base modulo 2^64, scrambled. Two different words of a corpus with 10^8 distinct words
share a hash with a probability of about 3 in 10^4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once; the arrays below take about 40 bytes for each.
BLOCK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0..n-1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, BASE, np.uint64))))
    return _powers[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, text after text, and the number of words of each text."""
    solid = ~_SPACE[data]
    first = solid.copy()  # bytes that begin a word: the one before is white space or of another text
    first[1:] &= ~solid[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = solid[begin]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    body = _LOWER[data[solid]]
    at = np.flatnonzero(first[solid])  # where each word begins among the solid bytes
    lengths = np.diff(np.append(at, len(body)))
    place = np.arange(len(body)) - np.repeat(at, lengths)
    terms = (body.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, at)), np.diff(np.searchsorted(starts, offsets))


def hashed_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, word hashes, words per text) for runs of texts of about BLOCK_BYTES; a longer text is a run of its own."""
    data, offsets = buffers(texts)
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        part = offsets[start : stop + 1]
        yield start, stop, *word_hashes(data[part[0] : part[-1]], part - part[0])
        start = stop
