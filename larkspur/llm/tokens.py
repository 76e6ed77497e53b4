"""Words of whole Arrow columns as 64-bit hashes, and a sketch of how often they stand in the corpus.

``units`` gives each unit of text (a line, or a whole text by its shingles) as a
sorted set of hashes; ``tally`` counts the hashes of all units of a corpus in a
fixed number of buckets, which orders the members of a set by rarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a sketch as powers of two: about sixteen a document between these bounds, a byte each.
SKETCH_BITS = (16, 24)
#: Buckets of a chunk of counts, the unit in which they are summed up.
CHUNK = 1 << 16
#: Bytes in which words are sought at a time.
PIECE = 1 << 22
#: Bytes of text that are worked on at a time.
SLICE = 1 << 19
#: Words longer than this are hashed one by one.
LONG = 256
#: Class of buckets that counted nothing but one token: 6 log2(1 + 1).
SINGLE = 6
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 56) - 1)


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """Table of bytes: 0 in words, 1 between words, 2 at the end of a unit."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = 1
    out[list(breaks)] = 2
    return out


LINES = kinds(b" \t\r\x0b\x0c", b"\n")
WORDS = kinds(b" \t\n\r\x0b\x0c")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 bounds) of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches, text: str):
    """The batches in slices of some rows, of about SLICE bytes of text, which a processor's cache can hold."""
    for b in batches:
        bounds = raw(b[text])[1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """(start, length, breaks) of the words of all texts; breaks are the places of the ends of units."""
    starts, ends, breaks, at = [], [], [], 0
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not table[data[end]] and not first[end]:  # a piece ends between words
            ahead = (table[data[end : end + PIECE]] > 0) | first[end : min(end + PIECE, len(data))]
            end += int(ahead.argmax()) if ahead.any() else len(ahead)
        kind = table[data[at:end]]
        word = kind == 0
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[at + 1 : end]
        stops = word
        stops[:-1] &= ~word[1:] | first[at + 1 : end]
        starts.append(np.flatnonzero(begins) + at)
        ends.append(np.flatnonzero(stops) + at + 1)
        breaks.append(np.flatnonzero(kind == 2) + at)
        at = end
    start, end, breaks = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, breaks))
    return start, end - start, breaks


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at the places, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mixed((eight[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _A)
    left, at = np.flatnonzero(length > 8), 8
    while len(left) and at < LONG:
        h[left] = mixed(h[left] * _A + (eight[start[left] + at] & _MASK[np.minimum(length[left] - at, 8)]))
        at += 8
        left = left[length[left] > at]
    if len(left):
        from xxhash import xxh64_intdigest as xxh

        for i in left.tolist():
            h[i] = xxh(data[start[i] : start[i] + length[i]].tobytes(), at)
    return h


def sections(start: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each of the ascending places the number of ascending cuts at or before it."""
    at = np.searchsorted(start, cuts)
    return np.repeat(np.arange(len(cuts) + 1), np.diff(at, prepend=0, append=len(start)))


def line_hashes(column: pa.Array):
    """(row, line number, hash) of every word of every line, in order; words are lower-cased, between ASCII white space."""
    data, bounds = raw(pc.utf8_lower(column))
    start, length, breaks = words(data, bounds, LINES)
    row = sections(start, bounds[1:-1])
    line = sections(start, breaks) - np.searchsorted(breaks, bounds[:-1])[row]
    return row, line, hashes(data, start, length)


def shingle_hashes(column: pa.Array, shingle: int):
    """(row, 0, hash) of every shingle of words of every text, in order; a text of fewer words is one shingle.

    A-Z are lower-cased; words stand between ASCII white space."""
    data, bounds = raw(pc.ascii_lower(column))
    start, length, _ = words(data, bounds, WORDS)
    row = sections(start, bounds[1:-1])
    h = hashes(data, start, length)
    n = np.bincount(row, minlength=len(column))  # words of each text
    first = np.cumsum(n) - n
    size = np.minimum(n, shingle)
    whole = np.arange(len(h)) + size[row] <= (first + n)[row]  # words that begin a shingle
    at, width = np.flatnonzero(whole), size[row][whole]
    out = np.zeros(len(at), np.uint64)
    for i in range(shingle):
        own = width > i
        out[own] = mixed(out[own] * _A + h[at[own] + i])
    return row[whole], np.zeros(len(at), np.int64), out


def order_within(unit: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places sorted by unit, then key; unit is ascending."""
    by_key = np.argsort(key)
    if len(unit) and unit[-1] < 1 << 16:
        unit = unit.astype(np.uint16)  # sorted by radix
    return by_key[np.argsort(unit[by_key], kind="stable")]


class Sets:
    """Sets of hashes, one per unit: row, number (of the line), n, and the members in one array.

    With a sketch the members are sorted by rarity: their key is the sketch's class above 56 bits of the hash."""

    def __init__(self, row: np.ndarray, number: np.ndarray, h: np.ndarray, sketch: np.ndarray | None = None):
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        unit = np.cumsum(new) - 1
        key = h
        if sketch is not None:
            key = (sketch[(h & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h & _LOW)
        order = order_within(unit, key)
        unit, key = unit[order], key[order]
        own = np.ones(len(h), bool)
        own[1:] = (unit[1:] != unit[:-1]) | (key[1:] != key[:-1])
        self.unit, self.key = unit[own], key[own]
        self.h = self.key if sketch is None else h[order][own]
        at = np.flatnonzero(new)
        self.row, self.number = row[at], number[at]
        self.n = np.bincount(self.unit, minlength=len(at))
        self.first = np.cumsum(self.n) - self.n

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name a set, whatever the order of its members."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.add.reduceat(mixed(self.h * k + _A), self.first).view(np.int64) for k in (_B, _C))

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """For each set the parities of its members in 128 classes."""
        bits = np.uint64(1) << (self.h & np.uint64(63))
        upper = (self.h & np.uint64(64)) > 0
        if not len(bits):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.bitwise_xor.reduceat(np.where(own, bits, np.uint64(0)), self.first).view(np.int64) for own in (~upper, upper))

    def bands(self, many: int) -> list:
        """For each set many numbers, each of the least members in two random orders: similar sets often have one in common."""
        if not len(self.h):
            return [np.zeros(0, np.int64)] * many
        least = [np.minimum.reduceat(mixed(self.h * _B + np.uint64(i + 1)), self.first) for i in range(2 * many)]
        return [mixed(a * _A + b).view(np.int64) for a, b in zip(least[::2], least[1::2], strict=True)]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first..first+n-1 of all pairs, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def tally(docs: DataFrame, units, rows: int) -> np.ndarray:
    """The count class (6 log2(1 + n), at most 255) of each hash bucket over all units of docs(text); 16 MB at most.

    units: column -> (row, number, hash); rows: about how many there are.  A task sends one compact row per chunk of buckets."""
    bits = min(max(rows.bit_length() + 4, SKETCH_BITS[0]), SKETCH_BITS[1])
    size = 1 << bits

    def counted(batches):
        total = np.zeros(size, np.uint32)
        for b in slices(batches, "text"):
            h = units(b.column(0))[2]
            np.add.at(total, (h & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        for c in range(0, size, CHUNK):
            at = np.flatnonzero(total[c : c + CHUNK])
            if len(at):
                row = [pa.array([c // CHUNK], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([total[c : c + CHUNK][at].tobytes()])]
                yield pa.RecordBatch.from_arrays(row, names=["chunk", "at", "n"])

    def summed(batches):
        sums: dict = {}
        for b in batches:
            for c, at, k in zip(*(b[x].to_pylist() for x in ("chunk", "at", "n")), strict=True):
                if c not in sums:
                    sums[c] = np.zeros(CHUNK, np.uint64)
                sums[c][np.frombuffer(at, np.uint16)] += np.frombuffer(k, np.uint32)
        for c, total in sums.items():
            cls = np.minimum(255, 6 * np.log2(total.astype(float) + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([cls.tobytes()])], names=["chunk", "classes"])

    parts = docs.select("text").mapInArrow(counted, "chunk int, at binary, n binary")
    rows = parts.repartition("chunk").mapInArrow(summed, "chunk int, classes binary").collect()  # a byte for each bucket
    out = np.zeros(max(size, CHUNK), np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["classes"], np.uint8)
    return out[:size]
