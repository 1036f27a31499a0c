"""The windows of a genome as runs, dealt by their seeds.

A run holds up to RUN windows that follow each other and whose seeds share their least MER-mer: 64 bases and one place,
25 bytes for four or five windows, where a row of one window took 28. Windows with the same seed are in the same one of
GROUPS groups, whatever run they came in. A row is what one task found for one group; windows are made from it where a
group is worked on, PART of them at a time, and no window travels by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna

from .genome import HALF, SEED_MASK, _CODE, codes, pieces

GROUPS = 2048
MER = 7
#: Windows of a run at most, so that two 32-base codes hold their bases.
RUN = 64 - dna.WINDOW + 1
#: Bases that a task cuts at once, and windows that it makes at once.
CHUNK, PART = 1 << 21, 1 << 20
SCHEMA = "grp int, runs binary"
#: Bytes of a run: place, two codes, number of windows.
_BYTES = 8 + 8 + 8 + 1
#: Set in the place of a window that holds a variant, so that the reference goes before it.
ALTERNATE = 1 << 62
_GROUP_BITS = np.uint16(GROUPS - 1)


@cache
def _ranks() -> np.ndarray:
    """Rank of each MER-mer: mixed up, but repeats of one to three bases last, since texts are full of them."""
    code = np.arange(4**MER, dtype=np.uint64)
    x = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
    for period in (1, 2, 3):
        same = code >> np.uint64(2 * period) == code & np.uint64(4 ** (MER - period) - 1)
        x[same] |= np.uint64(1 << 63)
    out = np.empty(4**MER, np.uint16)
    out[np.argsort(x, kind="stable")] = np.arange(4**MER)
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x, size = np.minimum(x[:-step], x[step:]), size + step
    return x


def groups_of(seed: np.ndarray) -> np.ndarray:
    """The group of each seed."""
    ranks, least = _ranks(), None
    for at in range(dna.SEED - MER + 1):
        r = ranks[seed >> 2 * at & 4**MER - 1]
        least = r if least is None else np.minimum(least, r)
    return least & _GROUP_BITS


def planes(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte, the lowest of all first: the high ones are alike and shrink."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def by_group(group: np.ndarray, arrays: list[np.ndarray], pack: Callable[..., bytes], names: list[str]) -> pa.RecordBatch:
    """A row for each group with its share of the arrays, packed."""
    order = np.argsort(group, kind="stable")
    g, arrays = group[order], [x[order] for x in arrays]
    edge = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), g[1:] != g[:-1]]))
    end = np.append(edge[1:], len(g))
    held = [pack(*(x[i:j] for x in arrays)) for i, j in zip(edge, end)]
    return pa.RecordBatch.from_arrays([pa.array(g[edge].astype(np.int32)), pa.array(held, pa.binary())], names)


def _pack(pos: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    return planes(pos) + a.tobytes() + b.tobytes() + n.tobytes()


def _cut(seqs: list[bytes], offsets: list[int]) -> pa.RecordBatch:
    """The runs of some sequences."""
    begin = np.cumsum([0] + [len(s) + 1 for s in seqs[:-1]])
    # A letter that is no base keeps windows from crossing; the last ones are there for the second codes.
    c = _CODE[np.frombuffer(b"N".join(seqs) + b"N" * 64, np.uint8)]
    n = len(c) - dna.WINDOW + 1
    bad = np.zeros(len(c) + 1, np.int32)
    np.cumsum(c > 3, out=bad[1:])
    ok = bad[dna.WINDOW :] == bad[:n]
    c &= 3
    shared = _least(_ranks()[codes(c, MER)], dna.SEED - MER + 1)[dna.WINDOW - dna.SEED :][:n]
    kind = np.where(ok, shared.astype(np.int32), -1)
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    size = np.diff(np.append(start, n))
    some = kind[start] >= 0
    start, size = start[some], size[some]
    parts = -(-size // RUN)
    step = RUN * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    start, size = np.repeat(start, parts) + step, np.minimum(np.repeat(size, parts) - step, RUN)
    of = np.searchsorted(begin, start, "right") - 1
    pos = np.asarray(offsets, np.int64)[of] + start - begin[of]
    long = codes(c, 32)
    return by_group(shared[start] & _GROUP_BITS, [pos, long[start], long[start + 32], size.astype(np.uint8)], _pack, ["grp", "runs"])


def chunked(batches, size: int = CHUNK) -> Iterator[tuple[list, ...]]:
    """The columns of rows whose last one holds texts or bytes, in lists of about `size` signs, whatever an Arrow batch holds."""
    rows, n = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            rows.append(row)
            n += len(row[-1])
            if n >= size:
                yield tuple(map(list, zip(*rows)))
                rows, n = [], 0
    if rows:
        yield tuple(map(list, zip(*rows)))


def of_genome(ctg: DataFrame, alternate: DataFrame | None = None) -> DataFrame:
    """(grp, runs): all windows of contigs that hold A, C, G, T only; alternate: windows with variants, (gpos, hi, lo)."""

    def run(batches):
        for offsets, seqs in chunked(batches):
            # A sign beyond ASCII is one place, as in the contigs' lengths.
            yield _cut([s.encode("ascii", "replace") for s in seqs], offsets)

    def single(batches):
        for batch in batches:
            pos, hi, lo = (np.asarray(batch.column(i)) for i in range(3))
            arrays = [pos | ALTERNATE, hi << 10 | lo >> 44, lo << 20, np.ones(len(pos), np.uint8)]
            yield by_group(groups_of(lo & SEED_MASK), arrays, _pack, ["grp", "runs"])

    out = pieces(ctg).select("offset", "seq").mapInArrow(run, SCHEMA)
    return out if alternate is None else out.union(alternate.select("gpos", "hi", "lo").mapInArrow(single, SCHEMA))


def is_packed(index: DataFrame) -> bool:
    return "runs" in index.columns


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a group together, one group after the other."""
    return rows.repartition("grp").sortWithinPartitions("grp")


def whole_groups(batches, enough: int = PART // 4 * _BYTES) -> Iterator[list[bytes]]:
    """What sorted rows hold of one group after the other, as many as have `enough` bytes."""
    held, at, n = [], None, 0
    for batch in batches:
        for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if g != at:
                if n >= enough:
                    yield held
                    held, n = [], 0
                at = g
            held.append(data)
            n += len(data)
    if held:
        yield held


def _windows(pos: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first half, second half) of the windows of runs that stand longest first."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    a, b = a.view(np.uint64), b.view(np.uint64)
    for j in range(int(n[0]) if len(n) else 0):
        k = len(n) - int(np.searchsorted(n[::-1], j, "right"))
        x = a[:k] << np.uint64(2 * j) | b[:k] >> np.uint64(1) >> np.uint64(63 - 2 * j)
        lo = (x & np.uint64(0x3FF)) << np.uint64(44) | b[:k] << np.uint64(2 * j) >> np.uint64(20)
        for part, got in zip(out, (pos[:k] + j, (x >> np.uint64(10)).view(np.int64), lo.view(np.int64))):
            part.append(got)
    return tuple(np.concatenate(x) for x in out)


def windows_of(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, first half, second half) of the windows of whole groups, in parts of about PART; a seed is in one part only."""
    cols: list[list[np.ndarray]] = [[] for _ in range(4)]
    for data in held:
        k = len(data) // _BYTES
        got = from_planes(data, k), np.frombuffer(data, np.int64, k, 8 * k), np.frombuffer(data, np.int64, k, 16 * k), np.frombuffer(data, np.uint8, k, 24 * k)
        for col, x in zip(cols, got):
            col.append(x)
    runs = [np.concatenate(x) for x in cols]
    order = np.argsort(255 - runs[3], kind="stable")
    runs = [x[order] for x in runs]
    parts = max(1, round(int(runs[3].sum()) / PART))
    if parts == 1:
        yield _windows(*runs)
        return
    step = PART // RUN
    for part in range(parts):
        # Made once more for each part, so that memory does not follow the size of a group.
        found = []
        for at in range(0, len(order), step):
            pos, hi, lo = _windows(*(x[at : at + step] for x in runs))
            mine = ((lo & SEED_MASK) * 0x9E3779B1 >> 13 & 0xFFFF) % parts == part
            found.append((pos[mine], hi[mine], lo[mine]))
        yield tuple(np.concatenate(x) for x in zip(*found))


def distinct(pos: np.ndarray, hi: np.ndarray, lo: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first half, second half, copies): windows once, with the least of their places. order: one in which equal windows meet."""
    mixed = None
    if order is None:
        mixed = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(mixed)
        mixed = mixed[order]
    a, b = hi[order], lo[order]
    other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if mixed is not None and (other & (mixed[1:] == mixed[:-1])).any():
        # Two windows share a mixture, so equal ones may stand apart.
        return distinct(pos, hi, lo, np.lexsort((lo, hi)))
    edge = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), other]))
    least = np.minimum.reduceat(pos[order], edge) if len(a) else pos
    return least, a[edge], b[edge], np.diff(np.append(edge, len(a)))


def _over(runs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """The arrays that `work` makes of each part's (place, first half, second half), as rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for held in whole_groups(batches):
            for part in windows_of(held):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*part)], names)

    return dealt(runs).mapInArrow(run, schema)


def copies(runs: DataFrame) -> DataFrame:
    """(copies, windows, places): how often distinct windows occur, with the sum of their first places."""

    def work(pos, hi, lo):
        least, _, _, n = distinct(pos, hi, lo)
        kinds, of, windows = np.unique(n, return_inverse=True, return_counts=True)
        places = np.zeros(len(kinds), np.int64)
        np.add.at(places, of, least)
        return kinds, windows, places

    return _over(runs, work, "copies long, windows long, places long").groupBy("copies").agg(F.sum("windows").alias("windows"), F.sum("places").alias("places"))


def bucket_histogram(runs: DataFrame) -> DataFrame:
    """(size, seeds): how many seeds have 1 .. 256 distinct windows; larger ones count as 257."""

    def work(pos, hi, lo):
        seeds, n = np.unique(distinct(pos, hi, lo)[2] & SEED_MASK, return_counts=True)
        return np.unique(np.minimum(n, 257), return_counts=True)

    return _over(runs, work, "size long, seeds long").groupBy("size").agg(F.sum("seeds").alias("seeds"))


def endings(runs: DataFrame, bases: int = 8) -> DataFrame:
    """(ending, n): distinct windows with the same last bases, counted by a task before the shuffle."""

    def run(batches):
        n = np.zeros(4**bases, np.int64)
        for held in whole_groups(batches):
            for part in windows_of(held):
                n += np.bincount(distinct(*part)[2] & 4**bases - 1, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["ending", "n"])

    return dealt(runs).mapInArrow(run, "ending long, n long").groupBy("ending").agg(F.sum("n").alias("n"))


def turned(x: np.ndarray, bases: int) -> np.ndarray:
    """Codes with their bases in reverse order."""
    x = x.view(np.uint64).byteswap()
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        x = (x & np.uint64(mask)) << np.uint64(shift) | x >> np.uint64(shift) & np.uint64(mask)
    return (x >> np.uint64(64 - 2 * bases)).view(np.int64)


#: First bases of reversed windows that are a stretch of their order.
STRETCH = 5


def rank_sums(runs: DataFrame, modulus: int, letters: int = 4) -> DataFrame:
    """(word, first_rank, last_rank, mixed): distinct windows in the order of their reversed text, by its first letters; mixed: the sum of rank * (place % modulus).

    A reversed window begins with its seed reversed, so the windows of a seed have neighbouring ranks: what a seed's windows
    are to each other is summed up where they are made, and only a seed's sums are put in order, at most 4**14 of them.
    """

    def work(pos, hi, lo):
        late, early = turned(lo, HALF), turned(hi, HALF)
        least, _, b, _ = distinct(pos, hi, lo, np.lexsort((early, late)))
        seed = turned(b & SEED_MASK, dna.SEED)
        edge = np.flatnonzero(np.concatenate([np.ones(min(len(seed), 1), bool), seed[1:] != seed[:-1]]))
        n = np.diff(np.append(edge, len(seed)))
        weight = least % modulus
        within = np.arange(len(seed)) - np.repeat(edge, n) + 1
        sums = [np.add.reduceat(x, edge) if len(seed) else x for x in (weight, within * weight)]
        batch = by_group(seed[edge] >> 2 * (dna.SEED - STRETCH), [seed[edge], n, *sums], lambda *x: b"".join(map(planes, x)), ["grp", "seeds"])
        return batch.columns

    def meet(batches):
        for held in whole_groups(batches, 1):
            seed, n, weight, mixed = (np.concatenate([from_planes(d, len(d) // 32, i * (len(d) // 4)) for d in held]) for i in range(4))
            order = np.argsort(seed)
            before = np.cumsum(n[order]) - n[order]
            row = int(seed[0]) >> 2 * (dna.SEED - STRETCH), int(n.sum()), int(weight.sum()), int((before * weight[order]).sum() + mixed.sum())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["stretch", "n", "weight", "mixed"])

    per = dealt(_over(runs, work, "grp int, seeds binary")).mapInArrow(meet, "stretch long, n long, weight long, mixed long")
    # One row for each of 4**STRETCH stretches; products beyond a long are decimals until they are summed up.
    big = lambda c: F.col(c).cast("decimal(19,0)")
    placed = per.withColumn("before", F.sum("n").over(Window.orderBy("stretch")) - F.col("n"))
    word = F.shiftright("stretch", 2 * (STRETCH - letters))
    got = placed.groupBy(word.alias("w")).agg((F.min("before") + 1).alias("first_rank"), F.max(F.col("before") + F.col("n")).alias("last_rank"), F.sum((big("before") * big("weight") + big("mixed")).cast("decimal(38,0)")).cast("long").alias("mixed"))
    return got.select(dna.kmer_text("w", letters).alias("word"), "first_rank", "last_rank", "mixed")
