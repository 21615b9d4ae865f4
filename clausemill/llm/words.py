"""Vectorised word splitting and hashing of Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text, as UTF-8 never uses those
bytes inside a longer character.  Everything here works on one slice of a batch
(a quarter of a MB, or one longer text), so that a Python worker's memory does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that separates words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same set as a regular expression for words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_INK = np.ones(256, dtype=bool)
_INK[list(SPACE_BYTES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of text handled at once; a single longer text is a slice of its own.
SLICE_BYTES = 256 << 10


def _family(seed: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, 256, dtype=np.uint64), np.uint64(rng.integers(0, 2**64, dtype=np.uint64) | 1)


#: Independent hash families: byte table and odd multiplier.
FAMILIES = tuple(_family(seed) for seed in (20011, 20021, 20023))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``target`` bytes of ``column``."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    group = np.cumsum(lengths, dtype=np.int64) // target
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


class Words:
    """Words of a slice of texts; null texts have none.

    ``start``/``end`` are byte positions in ``data``; ``doc`` is the row of each
    word; words of row r are ``first[r]:first[r + 1]``.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        ink = _INK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins, stops = ink.copy(), ink.copy()
        if len(data):
            begins[1:] &= ~ink[:-1] | edge[1:-1]
            stops[:-1] &= ~ink[1:] | edge[1:-1]
        self.data, self.ink = data, ink
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.stop_word = np.repeat(self.first[1:], np.diff(self.first))  # end of the word's own text, in words

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, family: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes, A-Z lower-cased if asked."""
        if not len(self):
            return np.zeros(0, np.uint64)
        table, base = FAMILIES[family]
        table = table[_LOWER] if lower else table
        lens = self.end - self.start
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lens.max()) - 1, base, np.uint64))), dtype=np.uint64)
        out = np.empty(len(self), np.uint64)
        # some words at a time, as the temporaries take tens of bytes a character
        cuts = [0, *(np.flatnonzero(np.diff(self.start // SLICE_BYTES)) + 1).tolist(), len(self)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            span = slice(self.start[a], self.end[b - 1])
            values = table[self.data[span][self.ink[span]]]
            at = np.cumsum(lens[a:b]) - lens[a:b]
            values *= powers[np.arange(len(values)) - np.repeat(at, lens[a:b])]
            out[a:b] = np.add.reduceat(values, at)
        return mix(out ^ (lens.astype(np.uint64) << np.uint64(40)))


def rolled(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hash of each ``width`` consecutive entries; entry i starts at i.

    Entries that run over the end of their text must be masked by the caller.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = FAMILIES[family][1]
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= base
        out += hashes[k : n + k]
    return mix(out)
