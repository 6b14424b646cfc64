"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vector operation covers.
CHUNK = 1 << 20

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        one = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        one[0] = back[0] = 1
        _POWERS[:] = [np.multiply.accumulate(one), np.multiply.accumulate(back)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of at most CHUNK bytes."""
    word = np.concatenate(([False], ~_BLANK[text], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = _powers(len(text) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * up[:-1])))
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Word hashes of runs of texts that fit one chunk, with each text's number of words."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) + 1 <= CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        if size <= CHUNK:
            hashes, first = word_hashes(np.frombuffer(b"\n".join(texts[at:stop]), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in texts[at:stop]])
            yield hashes, np.diff(np.searchsorted(first, ends), prepend=0).tolist()
        else:  # one long text: pieces that end at a blank
            text, parts, i = texts[at], [], 0
            while i < len(text):
                j = min(len(text), i + CHUNK)
                if j < len(text):
                    cut = max(text.rfind(c, i, j) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
                    j = cut if cut > i else j + len(text[j:].split(None, 1)[0] if not text[j : j + 1].isspace() else b"")
                parts.append(word_hashes(np.frombuffer(text[i:j], np.uint8))[0])
                i = j
            hashes = np.concatenate(parts)
            yield hashes, [len(hashes)]
        at = stop


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words than size, the whole sequence is one."""
    for hashes, counts in _chunks(texts):
        n = len(hashes) - size + 1
        long = mixed(sum((hashes[k : k + n] * _PLACE[k] for k in range(1, size)), hashes[:n] * _PLACE[0])) if n > 0 else hashes[:0]
        at = 0
        for m in counts:
            if m >= size:
                yield np.unique(long[at : at + m - size + 1])
            elif m:
                yield mixed((hashes[at : at + m] * _PLACE[8 : 8 + m]).sum(keepdims=True) + _U(m))
            else:
                yield hashes[:0]
            at += m


def batch_texts(batch: pa.RecordBatch, column: str = "text", rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts in UTF-8; null is empty."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [t.as_py() or b"" for t in part.column(column).cast(pa.binary())]


def parity_bits(shingles: np.ndarray, spread: int = 1) -> bytes:
    """A bitmap of at least spread bits a shingle, each bit the parity of the shingles that fall on it.

    The bits in which two sets' bitmaps differ are at most the shingles in which the sets differ.
    """
    width = max(64, 1 << (spread * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles.view(_U) & _U(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()
