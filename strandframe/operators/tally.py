"""Counting codes: each task sorts its own, a thousand ranges of them travel packed, and a range is added up in one array."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna

from .genome import _CODE, codes, pieces
from .runs import by_group, chunked, dealt

#: Bits of a mixed code that are its range, and of a range that is added up in an array of all its codes.
RANGE, DENSE = 10, 20
#: An odd number: codes times it, modulo their number, are the same codes in another order, so ranges are even.
_MIX = 0x9E3779B97F4A7C15


def _narrow(x: np.ndarray) -> bytes:
    """Integers from 0 in as few bytes as the largest needs, byte by byte; their width first."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _widened(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """Inverse: n integers that stand at a place, and the place behind them."""
    width = data[at]
    held = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return np.ascontiguousarray(held).view(f"<u{width}").ravel().astype(np.int64), at + 1 + n * width


def pack(code: np.ndarray, n: np.ndarray) -> bytes:
    """Rising codes with their numbers."""
    return len(code).to_bytes(4, "little") + _narrow(np.diff(code, prepend=code[:1] * 0)) + _narrow(n)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    step, at = _widened(data, size, 4)
    return np.cumsum(step), _widened(data, size, at)[0]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    code = code[order]
    edge = np.flatnonzero(np.concatenate([np.ones(min(len(code), 1), bool), code[1:] != code[:-1]]))
    return code[edge], np.add.reduceat(n[order], edge) if len(code) else n


def tally(sequences: DataFrame, codes_of: Callable[[np.ndarray], np.ndarray], bits: int) -> DataFrame:
    """(code, n): how often codes_of gives each code of `bits` bits. sequences: one column, as bytes.

    codes_of gets the base codes of some sequences, with one that is no base between them.
    """
    mask = np.uint64((1 << bits) - 1)
    low = max(0, bits - RANGE)

    def count(batches):
        for (seqs,) in chunked(batches):
            mixed = codes_of(_bases(seqs)).astype(np.uint64) * np.uint64(_MIX) & mask
            mixed.sort()
            edge = np.flatnonzero(np.concatenate([np.ones(min(len(mixed), 1), bool), mixed[1:] != mixed[:-1]]))
            code = mixed[edge].view(np.int64)
            yield by_group((code >> low).astype(np.uint16), [code & (1 << low) - 1, np.diff(np.append(edge, len(mixed)))], pack, ["grp", "codes"])

    def total(at: int, found: Iterator[bytes]) -> pa.RecordBatch:
        if low <= DENSE:
            n = np.zeros(1 << low, np.int64)
            for data in found:
                code, times = unpack(data)
                n[code] += times
            code = np.flatnonzero(n)
            n = n[code]
        else:
            held, new = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
            for data in found:
                new.append(unpack(data))
                if sum(len(c) for c, _ in new) > max(1 << DENSE, len(held[0])):
                    held, new = _merged([held, *new]), []
            code, n = _merged([held, *new])
        back = np.uint64(pow(_MIX, -1, 1 << bits))
        code = (code | at << low).astype(np.uint64) * back & mask
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    def add(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for at, found in itertools.groupby(rows, lambda r: r[0]):
            yield total(at, (data for _, data in found))

    return dealt(sequences.mapInArrow(count, "grp int, codes binary")).mapInArrow(add, "code long, n long")


def _bases(seqs: list[bytes]) -> np.ndarray:
    """Base codes of sequences side by side, with one behind each that is no base."""
    return _CODE[np.frombuffer(b"".join(s + b"." for s in seqs), np.uint8)]


def seed_counts(ctg: DataFrame) -> DataFrame:
    """(seed, n): windows of each seed."""

    def seeds(c: np.ndarray) -> np.ndarray:
        n = max(0, len(c) - dna.WINDOW + 1)
        bad = np.zeros(len(c) + 1, np.int32)
        np.cumsum(c > 3, out=bad[1:])
        return codes(c & 3, dna.SEED)[dna.WINDOW - dna.SEED :][:n][bad[dna.WINDOW :] == bad[:n]] if n else np.zeros(0, np.int64)

    return tally(pieces(ctg).select(F.col("seq").cast("binary")), seeds, 2 * dna.SEED).select(F.col("code").cast("int").alias("seed"), "n")


def window_count(ctg: DataFrame) -> DataFrame:
    """(made): how many windows hold A, C, G, T only."""

    def run(batches):
        n = 0
        for (seqs,) in chunked(batches):
            bad = np.concatenate([[0], np.cumsum(_bases(seqs) > 3, dtype=np.int32)])
            n += int(np.count_nonzero(bad[dna.WINDOW :] == bad[: -dna.WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["made"])

    return pieces(ctg).select(F.col("seq").cast("binary")).mapInArrow(run, "made long").agg(F.coalesce(F.sum("made"), F.lit(0)).alias("made"))
