"""Words and n-grams of whole Arrow batches of texts as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than blank and 0x09-0x0D, with A-Z lowered. Its hash is a polynomial over its bytes, taken
from prefix sums over the batch and then mixed. Null counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
SEED = 0x2545F4914F6CDD1D
# Texts of a batch are worked on in pieces of about so many bytes; one longer text is a piece of its own.
PIECE_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def multipliers(n: int) -> np.ndarray:
    """n fixed odd factors, one for each place of an n-gram."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)


@dataclass
class Piece:
    """Some rows of a batch: first row, bytes, the rows' byte bounds, and per word its bounds, hash and row."""
    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    # Word index at which each row begins, with the total at the end.
    rows: np.ndarray
    # Prefix sums of the polynomial and the inverse powers that turn their differences into hashes.
    sums: np.ndarray | None = None
    down: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.rows))

    def stems(self, n: int) -> np.ndarray:
        """Hash of each word's first n bytes."""
        ends = np.minimum(self.ends, self.starts + n)
        return mix((self.sums[ends] - self.sums[self.starts]) * self.down[self.starts] + np.uint64(n * SEED % 2**64))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n-gram that begins at each word, and whether it lies inside one text."""
        total = len(self.hashes)
        out = np.zeros(total, np.uint64)
        for place, factor in enumerate(multipliers(n)):
            if place < total:
                out[: total - place] += self.hashes[place:] * factor
        left = np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(total)
        return mix(out), left >= n

    def sequences(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Row and sorted distinct n-gram hashes; a text of fewer words counts whole, one without words has none."""
        grams, inside = self.ngrams(n)
        for row in range(len(self)):
            a, b = self.rows[row], self.rows[row + 1]
            if b - a >= n:
                yield row, np.unique(grams[a:b][inside[a:b]])
            elif b > a:
                whole = (self.hashes[a:b] * multipliers(n)[: b - a]).sum(keepdims=True, dtype=np.uint64)
                yield row, mix(whole + np.uint64(int(b - a) * BASE % 2**64))
            else:
                yield row, np.zeros(0, np.uint64)


class Scanner:
    """Cuts Arrow string arrays into pieces. Holds the powers of the polynomial, so make one for each task.

    With letters_only, words are runs of ASCII letters, digits and bytes above 127, so that punctuation parts them.
    """

    def __init__(self, letters_only: bool = False):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.blank = np.zeros(256, bool)
        if letters_only:
            self.blank[:128] = [not chr(c).isalnum() for c in range(128)]
        else:
            self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(BASE, -1, 2**64)
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up, self.down

    def pieces(self, texts: pa.Array) -> Iterator[Piece]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        offsets = offsets.astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
            yield self._piece(row, data[offsets[row]: offsets[stop]], offsets[row: stop + 1] - offsets[row])
            row = stop

    def _piece(self, first: int, raw: np.ndarray, bounds: np.ndarray) -> Piece:
        data = self.lower[raw]
        inside = ~self.blank[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = bounds[:-1] < bounds[1:]
        before[bounds[:-1][filled]] = False
        after[bounds[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(SEED))
        return Piece(first, raw, bounds, starts, ends, hashes, np.searchsorted(starts, bounds), sums, down)
