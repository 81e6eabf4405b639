"""Occurrences of hashed keys in a table of fixed size: which slots can hold a frequent key.

A task counts the slots of its keys and passes them on as compressed pieces, about one or two bytes for a distinct
key. A piece of the table is summed up by one task, whatever the number of rows it gets, and becomes bits.
A key whose slot is not marked is rare for certain, so it need not be shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

PART = 18  # bits of a slot's number inside its piece


def slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slots of unsigned 64-bit keys: their first bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


class Counts:
    """Occurrences per slot, passed on when `room` distinct ones are held: rows (part, first, size, slots, n)."""

    def __init__(self, bits: int, room: int):
        self.bits, self.room, self.held, self.size = bits, room, [], 0

    def add(self, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(slots, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > self.room:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            slots, n = (np.concatenate(c) for c in zip(*self.held, strict=True))
            slots, of = np.unique(slots, return_inverse=True)
            n = np.bincount(of, weights=n).astype(np.uint32)
            cuts = np.searchsorted(slots, np.arange((1 << max(0, self.bits - PART)) + 1) << PART)
            rows = [(i, slots[a:b], n[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([int(r[1][0]) for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int32()),
                pa.array([_packed(np.diff(r[1], prepend=r[1][:1]).astype(np.uint32)) for r in rows], pa.binary()),
                pa.array([_packed(r[2]) for r in rows], pa.binary()),
            ], names=["part", "first", "size", "slots", "n"])
        self.held, self.size = [], 0


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed by bytes of equal weight, as the high ones are nearly all zero."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view(np.uint32).ravel()


def likely(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, least: int, room: int, piece: int,
           column: int = 1) -> np.ndarray:
    """Packed bits, 2 ** bits / 8 bytes, of the slots whose keys occur `least` times or more together. `keys_of` gives the
    keys of a batch of rows, cut so that texts (their column) take about `piece` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts(bits, room)
        for batch in slices(batches, column, piece):
            yield from sums.add(slots_of(keys_of(batch), bits))
        yield from sums.flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            marked = np.packbits(held >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([marked], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if part is not None:
                        yield done()
                    part, held = r["part"], np.zeros(1 << min(bits, PART), np.int64)
                slots = r["first"] - (part << PART) + np.cumsum(_unpacked(r["slots"], r["size"]).astype(np.int64))
                held[slots] += _unpacked(r["n"], r["size"])
        if part is not None:
            yield done()

    pieces = rows.mapInArrow(run, "part int, first long, size int, slots binary, n binary")
    summed = pieces.repartition("part").sortWithinPartitions("part").mapInArrow(total, "part int, bits binary")
    out = np.zeros(max(1, 1 << (bits - 3)), np.uint8)
    for r in summed.collect():
        at = r.part << (PART - 3)
        out[at:at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out
