"""Vectorised word and shingle hashing over Arrow string columns (numpy, inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are folded to a-z.
Words are hashed with a polynomial over randomised byte values modulo 2**64, read off
prefix sums, so a batch costs a few array passes and no per-word Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambler of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the column, n+1 offsets into them); a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches, size: int, column: str = "text"):
    """The batches cut into runs of rows with about ``size`` bytes of text each (a longer text stands alone); none is empty."""
    for batch in batches:
        _, off = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class WordHasher:
    """Word hashes of every text of a column, computed in blocks of bounded size."""

    def __init__(self, fold: bool = True, block: int = 1 << 20) -> None:
        self.block = block
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        codes = np.arange(256, dtype=np.uint64)
        if fold:
            codes[65:91] += np.uint64(32)
        self.value = mix(codes + np.uint64(0x5851F42D4C957F2D))
        self.inverse = np.uint64(pow(_MULT, -1, 1 << 64))
        self._grow(block)

    def _grow(self, n: int) -> None:
        step = np.full(n + 1, _MULT, np.uint64)
        back = np.full(n + 1, self.inverse, np.uint64)
        step[0] = back[0] = 1
        self.power, self.unpower = np.cumprod(step), np.cumprod(back)

    def _cut(self, raw: np.ndarray, off: np.ndarray, at: int) -> int:
        """End of the block that starts at ``at``: a text boundary or a space if there is one in reach."""
        end = at + self.block
        if end >= len(raw):
            return len(raw)
        bound = off[np.searchsorted(off, end, "right") - 1]
        if bound > at:
            return int(bound)
        inside = np.flatnonzero(self.space[raw[at:end]])
        if len(inside):
            return at + int(inside[-1]) + 1
        nxt = int(off[np.searchsorted(off, end, "right")])
        later = np.flatnonzero(self.space[raw[end:nxt]])
        return end + int(later[0]) + 1 if len(later) else nxt

    def spans(self, raw: np.ndarray, off: np.ndarray):
        """Yields (first, ends, hashes) of the words of each block, as positions in ``raw``."""
        at = 0
        while at < len(raw):
            end = self._cut(raw, off, at)
            part = raw[at:end]
            if len(part) >= len(self.power):
                self._grow(len(part))
            word = ~self.space[part]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            bounds = off[np.searchsorted(off, at, "left") : np.searchsorted(off, end, "left")] - at
            first[bounds] = word[bounds]
            inner = bounds[bounds > 0]
            last[inner - 1] = word[inner - 1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.value[part] * self.power[: len(part)], out=total[1:])
            yield a + at, b + at, mix((total[b] - total[a]) * self.unpower[a] + (b - a).astype(np.uint64))
            at = end

    def words(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(n+1 word offsets of the texts, hashes of all words in order)."""
        raw, off = text_buffer(col)
        firsts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, _, h in self.spans(raw, off):
            firsts.append(a)
            hashes.append(h)
        return np.searchsorted(np.concatenate(firsts), off, "left"), np.concatenate(hashes)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (runs that cross texts are the caller's to drop)."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(_MULT) + hashes[i : i + n]
    return mix(out)


def shingle_sets(word_off: np.ndarray, hashes: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    runs = combine(hashes, k)
    out = []
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(combine(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: np.ndarray | int, percent: int = 80):
    """Smallest overlap that any set of n elements needs for 100 * overlap >= percent * union."""
    return -(-percent * n // 100)
