"""Which hashed items occur in two documents or more, exactly counted and kept in a bounded bitmap.

Tasks reduce their items to sorted runs, dealt by value ranges; each range is merged and counted by
one task.  What comes back is a bitmap of at most ``BYTES``, smaller for few items, with one bit for
many values once the corpus is large: a set bit only means "maybe shared", which costs work, never
results.  With two marks a value has a second bit in the same 64 bytes, so that fewer others pass while
the bitmap is far from full.  Optionally the values of the highest counts are returned too, again a
bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import pack_ints, pack_sorted, shuffle_files_removed, shuffle_width, squeeze, unpack_ints, unpack_sorted, unsqueeze

BITS = 44  # of an item's 64-bit hash
BYTES, LEAST, BLOCK = 1 << 25, 1 << 20, 64
_FLUSH = 2_000_000
_SCHEMA = "part int, items binary, counts binary"


def bitmap_bytes(items: int) -> int:
    """A power of two with 16 bits an item, as far as the bounds allow."""
    return min(BYTES, max(LEAST, 1 << max(2 * items - 1, 1).bit_length()))


def first_byte(part: int, parts: int, size: int = BYTES) -> int:
    return -(-part * (size // BLOCK) // parts) * BLOCK


def shift(size: int) -> int:
    """Bits of an item below those that number its bit of a bitmap."""
    return BITS - (size.bit_length() + 2)


def second(item: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Another bit in the block of ``bit``, by bits of the item that did not choose that one."""
    block = BLOCK * 8 - 1
    return (bit & ~block) | (item & np.uint64(block)).astype(np.int64)


class Collector:
    """Gathers items (each document's own distinct ones) and hands them on as sorted runs."""

    def __init__(self, parts: int, size: int, count: int = 1):
        self.held, self.size, self.count = [], 0, count
        self.cuts = np.array([first_byte(p, parts, size) << (shift(size) + 3) for p in range(parts + 1)], np.uint64)

    def add(self, hashes: np.ndarray):
        self.held.append(hashes >> np.uint64(64 - BITS))
        self.size += len(hashes)
        if self.size >= _FLUSH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        items = np.sort(np.concatenate(self.held)) if self.held else np.empty(0, np.uint64)
        self.held, self.size = [], 0
        first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.empty(0, np.int64)
        counts, items = np.diff(np.append(first, len(items))) * self.count, items[first]
        edge = np.searchsorted(items, self.cuts)
        some = [p for p in range(len(self.cuts) - 1) if edge[p + 1] > edge[p]]
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([pack_sorted(items[edge[p] : edge[p + 1]]) for p in some], pa.binary()),
            pa.array([pack_ints(counts[edge[p] : edge[p + 1]]) for p in some], pa.binary())], names=["part", "items", "counts"])


class Shared:
    """The result: ``bits`` and the ``heavy`` items (ascending) with their counts."""

    def __init__(self, bits: np.ndarray, heavy: np.ndarray, counts: np.ndarray, marks: int = 1):
        self.bits, self.heavy, self.counts, self.marks = bits, heavy, counts, marks
        self.shift = shift(len(bits))

    def __getstate__(self) -> tuple:
        return squeeze(self.bits.tobytes()), self.heavy, self.counts, self.marks

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.heavy, self.counts, self.marks = np.frombuffer(unsqueeze(state[0]), np.uint8), *state[1:]
        self.shift = shift(len(self.bits))

    def _set(self, bit: np.ndarray) -> np.ndarray:
        return ((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        bit = (hashes >> np.uint64(64 - BITS + self.shift)).astype(np.int64)
        out = self._set(bit)
        if self.marks > 1:
            out[out] = self._set(second(hashes[out] >> np.uint64(64 - BITS), bit[out]))
        return out

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """1 where surely alone, the exact count of a heavy item, else 2."""
        out = np.where(self.maybe(hashes), 2, 1)
        if len(self.heavy):
            two = np.flatnonzero(out == 2)
            item = hashes[two] >> np.uint64(64 - BITS)
            at = np.minimum(np.searchsorted(self.heavy, item), len(self.heavy) - 1)
            good = self.heavy[at] == item
            out[two[good]] = self.counts[at[good]]
        return out


def shared(docs: DataFrame, items, count: int = 1, heavy: int = 0, heavy_from: int = 16, size: int = BYTES, marks: int = 1) -> Shared:
    """``items(batch)`` gives arrays of hashes, each distinct within its document, for a batch of ``docs``; ``size``: bytes of the bitmap; ``marks``: bits of a value, 1 or 2."""
    parts = shuffle_width(docs.sparkSession)

    def runs(batches):
        held = Collector(parts, size, count)
        for batch in batches:
            for hashes in items(batch):
                yield from held.add(hashes)
        if held.size:
            yield held.flush()

    def merge(batches):
        part, items, counts = None, [], []
        for batch in batches:
            for p, i, c in zip(*(batch.column(k).to_pylist() for k in ("part", "items", "counts")), strict=True):
                part = p
                items.append(unpack_sorted(i))
                counts.append(unpack_ints(c).astype(np.uint32))
        if part is None:
            return
        item, n = np.concatenate(items), np.concatenate(counts)
        del items, counts
        order = np.argsort(item, kind="stable")
        item, n = item[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        item, n = item[first], np.add.reduceat(n, first)
        lo, hi = first_byte(part, parts, size), first_byte(part + 1, parts, size)
        mark = np.zeros((hi - lo) * 8, np.uint8)
        bit = (item[n >= 2] >> np.uint64(shift(size))).astype(np.int64)
        mark[bit - lo * 8] = 1
        if marks > 1:
            mark[second(item[n >= 2], bit) - lo * 8] = 1
        top = np.flatnonzero(n >= heavy_from) if heavy else np.empty(0, np.int64)
        most = max(1, heavy // parts)
        if len(top) > most:
            top = np.sort(top[np.argpartition(n[top], len(top) - most)[len(top) - most :]])
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([squeeze(np.packbits(mark, bitorder="little").tobytes())], pa.binary()),
            pa.array([pack_sorted(item[top])], pa.binary()), pa.array([n[top].astype("<u4").tobytes()], pa.binary())], names=["part", "bits", "items", "counts"])

    with shuffle_files_removed(docs.sparkSession):
        found = docs.mapInArrow(runs, _SCHEMA).repartitionById(parts, "part").mapInArrow(merge, "part int, bits binary, items binary, counts binary").collect()
    bits, top, counts = np.zeros(size, np.uint8), [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for r in sorted(found, key=lambda r: r["part"]):  # ``size`` bytes and ``heavy`` entries in all
        got = np.frombuffer(unsqueeze(bytes(r["bits"])), np.uint8)
        bits[first_byte(r["part"], parts, size) :][: len(got)] = got
        top.append(unpack_sorted(bytes(r["items"])))
        counts.append(np.frombuffer(bytes(r["counts"]), "<u4"))
    return Shared(bits, np.concatenate(top), np.concatenate(counts), marks)
