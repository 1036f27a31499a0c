"""Placing reads on the window index: probes, seed join, Hamming filter, first match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna

from . import runs
from .genome import HALF, SEED_MASK, _CODE

TRIES = 3
_POWERS = (4 ** np.arange(HALF - 1, -1, -1)).astype(np.int64)


def probe_offsets(length: int, tries: int = TRIES) -> list[int]:
    """Starts of the windows of a read that are looked up, in order."""
    if length < dna.MIN_READ:
        return []
    n = min(tries, length - dna.MIN_READ + 1)
    skip = length // 10
    step = (length - dna.WINDOW - 2 * skip) // (n - 1) if n > 1 else 0
    return [skip + i * step for i in range(n)]


def _probe_columns(rid: np.ndarray, seqs: list[str], tries: int) -> list[np.ndarray]:
    """rid, strand, attempt, at, hi, lo of the probes of some reads."""
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        by_length.setdefault(len(s), []).append(i)
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for length, rows in by_length.items():
        offs = probe_offsets(length, tries)
        grid = _CODE[np.frombuffer("".join([seqs[i] for i in rows]).encode(), np.uint8).reshape(len(rows), length)].astype(np.int64)
        for strand, g in ((0, grid), (1, 3 - grid[:, ::-1])):
            for attempt, at in enumerate(offs):
                one = (rid[rows], np.full(len(rows), strand), np.full(len(rows), attempt), np.full(len(rows), at), g[:, at : at + HALF] @ _POWERS, g[:, at + HALF : at + 2 * HALF] @ _POWERS)
                for col, x in zip(cols, one):
                    col.append(x)
    return [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in cols]


def _fit(reads: DataFrame) -> DataFrame:
    return reads.where(dna.long_enough("seq") & dna.only_bases("seq")).select(F.col("rid").cast("long").alias("rid"), "seq")


def probes(reads: DataFrame, tries: int = TRIES) -> DataFrame:
    """(rid, strand, attempt, at, hi, lo, seed): windows of reads of A, C, G, T only, forward (0) and reverse complement (1)."""

    def run(batches):
        for batch in batches:
            cat = _probe_columns(np.asarray(batch.column(0)), batch.column(1).to_pylist(), tries)
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
            arrays = [pa.array(c.astype(k)) for c, k in zip(cat, kinds)] + [pa.array((cat[5] & SEED_MASK).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "strand", "attempt", "at", "hi", "lo", "seed"])

    return _fit(reads).mapInArrow(run, "rid long, strand int, attempt int, at int, hi long, lo long, seed int")


#: A probe in the bytes of a group.
PROBE = np.dtype([("rid", "<i8"), ("strand", "i1"), ("attempt", "<i4"), ("at", "<i4"), ("hi", "<i8"), ("lo", "<i8")])


def _dealt_probes(cols: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each group of seeds with the probes that have one."""
    one = np.empty(len(cols[0]), PROBE)
    for name, col in zip(PROBE.names, cols):
        one[name] = col
    return runs.by_group(runs.groups_of(one["lo"] & SEED_MASK), [one], np.ndarray.tobytes, ["grp", "probes"])


def packed_probes(reads: DataFrame, tries: int = TRIES) -> DataFrame:
    """(grp, probes): the same as probes(), to be looked up in runs."""

    def run(batches):
        for batch in batches:
            yield _dealt_probes(_probe_columns(np.asarray(batch.column(0)), batch.column(1).to_pylist(), tries))

    return _fit(reads).mapInArrow(run, "grp int, probes binary")


def packed(probe: DataFrame) -> DataFrame:
    """Rows of probes() as those of packed_probes()."""

    def run(batches):
        for batch in batches:
            yield _dealt_probes([np.asarray(c) for c in batch.columns])

    return probe if "probes" in probe.columns else probe.select(*PROBE.names).mapInArrow(run, "grp int, probes binary")


def index_of(probe: DataFrame, ctg: DataFrame, alternate: DataFrame | None = None) -> DataFrame:
    """The distinct windows that have the seed of a probe, made for these probes alone; without storing an index of all."""
    from .genome import distinct_windows, seed_bitmap, windows

    seeds = seed_bitmap(probe)
    if alternate is not None:
        alternate = alternate.join(probe.select("seed").distinct(), "seed", "left_semi")
    return distinct_windows(windows(ctg, seeds, once=True), alternate)


def _words(hi: str, lo: str) -> list:
    """The WORDS words of eight bases before the seed of a window."""
    cut = lambda c, bits: F.shiftright(F.col(c), bits).bitwiseAND(F.lit(0xFFFF))
    across = F.shiftleft(F.col(hi).bitwiseAND(F.lit(0x3F)), 10).bitwiseOR(F.shiftright(F.col(lo), 44).bitwiseAND(F.lit(0x3FF)))
    return [cut(hi, 38), cut(hi, 22), cut(hi, 6), across, cut(lo, 28)]


#: Windows of a seed in a group of runs beyond which its probes go by words, and pairs that are compared at once.
MANY, PAIRS = 64, 1 << 21


def _pairs(p: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, window) numbers of equal keys, some PAIRS at a time; w is sorted."""
    first = np.searchsorted(w, p, "left")
    n = np.searchsorted(w, p, "right") - first
    some = np.flatnonzero(n)
    ends, at, done = np.cumsum(n[some]), 0, 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        k = n[some[at:to]]
        yield np.repeat(some[at:to], k), np.repeat(first[some[at:to]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        at, done = to, int(ends[to - 1])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bases in which 27-base codes differ."""
    d = a ^ b
    return np.bitwise_count((d | d >> 1) & 0x15555555555555).astype(np.int32)


def _near(p: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, window, mismatches) of the pairs with the same seed and fewer than MISMATCHES; each pair once."""

    def close(pi, wi):
        d = _differ(p["hi"][pi], hi[wi])
        fit = np.flatnonzero(d < dna.MISMATCHES)
        pi, wi, d = pi[fit], wi[fit], d[fit]
        d += _differ(p["lo"][pi], lo[wi])
        fit = d < dna.MISMATCHES
        return pi[fit], wi[fit], d[fit]

    seed = lo & SEED_MASK
    order = np.argsort(seed)
    edge = np.flatnonzero(np.concatenate([np.ones(min(len(seed), 1), bool), np.diff(seed[order]) != 0]))
    n = np.diff(np.append(edge, len(seed)))
    many = np.repeat(n > MANY, n)
    asked = p["lo"] & SEED_MASK
    few = order[~many]
    for pi, wi in _pairs(asked, seed[few]):
        yield close(pi, few[wi])
    rest, hot = order[many], seed[order[edge[n > MANY]]]
    mine = np.flatnonzero(np.isin(asked, hot))
    if not len(mine):
        return
    # With fewer mismatches than words one word is equal, and a pair counts at its first equal word.
    of_p, of_w = _word_codes(p["hi"][mine], p["lo"][mine]), _word_codes(hi[rest], lo[rest])
    for k in range(dna.WORDS):
        key = seed[rest] << 16 | of_w[k]
        by = np.argsort(key)
        for pi, wi in _pairs(asked[mine] << 16 | of_p[k], key[by]):
            wi = by[wi]
            first = np.ones(len(pi), bool)
            for j in range(k):
                first &= of_p[j][pi] != of_w[j][wi]
            yield close(mine[pi[first]], rest[wi[first]])


def _word_codes(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """The WORDS words of eight bases before the seed of a window."""
    return [hi >> 38 & 0xFFFF, hi >> 22 & 0xFFFF, hi >> 6 & 0xFFFF, (hi & 0x3F) << 10 | lo >> 44 & 0x3FF, lo >> 28 & 0xFFFF]


HIT_SCHEMA = pa.schema([("rid", pa.int64()), ("strand", pa.int32()), ("attempt", pa.int32()), ("at", pa.int32()), ("mismatches", pa.int32()), ("gpos", pa.int64())])
HIT_COLUMNS = "rid long, strand int, attempt int, at int, mismatches int, gpos long"


def _met(p: np.ndarray, held: list[bytes]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each part of the runs of a group (probe, place, mismatches) of its hits, some at a time; a probe has hits in one part only."""

    def mark(seed):
        return seed * 0x9E3779B1 >> 20 & 0xFFFFF

    some = np.zeros(1 << 20, bool)
    some[mark(p["lo"] & SEED_MASK)] = True
    for pos, hi, lo in runs.windows_of(held):
        kept = some[mark(lo & SEED_MASK)]
        pos, hi, lo, _ = runs.distinct(pos[kept], hi[kept], lo[kept])
        pos &= ~runs.ALTERNATE
        yield ((pi, pos[wi], d) for pi, wi, d in _near(p, hi, lo))


def _best(pi: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest and then first hit of each probe."""
    order = np.lexsort((at, d, pi))
    order = order[np.concatenate([np.ones(min(len(pi), 1), bool), np.diff(pi[order]) != 0])]
    return pi[order], at[order], d[order]


def _hit_columns(p: np.ndarray, pi: np.ndarray, at: np.ndarray, d: np.ndarray) -> list[pa.Array]:
    cols = *(p[n][pi] for n in ("rid", "strand", "attempt", "at")), d, at
    return [pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(cols, HIT_SCHEMA)]


def _best_in_runs(probe: DataFrame, index: DataFrame) -> DataFrame:
    """The best hit of each probe; of a stored index no row moves."""

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            p = np.frombuffer(b"".join(asked.column("probes").to_pylist()), PROBE)
            for part in _met(p, held.column("runs").to_pylist()):
                found = [_best(*x) for x in part]
                if found:
                    out.append(pa.RecordBatch.from_arrays(_hit_columns(p, *_best(*map(np.concatenate, zip(*found)))), schema=HIT_SCHEMA))
        return pa.Table.from_batches(out, HIT_SCHEMA)

    return index.groupBy("grp").cogroup(packed(probe).groupBy("grp")).applyInArrow(meet, HIT_COLUMNS)


def _beside(probe: DataFrame, index: DataFrame, work, schema: str) -> DataFrame:
    """What work(probes, runs) yields for each group: rows of both are dealt together, and results leave as they are made."""

    def run(batches):
        at, p, held = None, [], []
        for batch in batches:
            for g, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if g != at:
                    if p and held:
                        yield from work(np.frombuffer(b"".join(p), PROBE), held)
                    at, p, held = g, [], []
                if kind == 0:
                    p.append(data)
                elif p:
                    held.append(data)
        if p and held:
            yield from work(np.frombuffer(b"".join(p), PROBE), held)

    both = packed(probe).select("grp", F.lit(0).alias("kind"), F.col("probes").alias("data")).union(index.select("grp", F.lit(1).alias("kind"), "runs"))
    return both.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(run, schema)


def _hits_in_runs(probe: DataFrame, index: DataFrame) -> DataFrame:
    def work(p, held):
        for part in _met(p, held):
            for found in part:
                yield pa.RecordBatch.from_arrays(_hit_columns(p, *found), schema=HIT_SCHEMA)

    return _beside(probe, index, work, HIT_COLUMNS)


def hit_counts(probe: DataFrame, index: DataFrame) -> DataFrame:
    """(mismatches, strand, n): how many hits there are, without a row for each. index: runs.

    Equal probes of a group are looked up once.
    """
    names = ["mismatches", "strand", "n"]

    def work(p, held):
        p = p[np.lexsort((p["lo"], p["hi"], p["strand"]))]
        edge = np.flatnonzero(np.concatenate([[True], (p["hi"][1:] != p["hi"][:-1]) | (p["lo"][1:] != p["lo"][:-1]) | (p["strand"][1:] != p["strand"][:-1])]))
        times, one = np.diff(np.append(edge, len(p))), p[edge]
        n = np.zeros(2 * dna.MISMATCHES, np.int64)
        for part in _met(one, held):
            for pi, _, d in part:
                np.add.at(n, 2 * d + one["strand"][pi], times[pi])
        kinds = np.flatnonzero(n).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kinds // 2), pa.array(kinds % 2), pa.array(n[kinds])], names)

    return _beside(probe, index, work, "mismatches int, strand int, n long").groupBy("mismatches", "strand").agg(F.sum("n").alias("n"))


def hits(probe: DataFrame, index: DataFrame, hot: DataFrame | None = None, best: bool = False) -> DataFrame:
    """(rid, strand, attempt, at, mismatches, gpos): index windows with the probe's seed and fewer than MISMATCHES differing bases.

    index: windows or runs; with runs, best leaves the nearest and then first window of each probe. The distance is part of
    the join condition, so a frequent seed costs comparisons and not rows. hot: seeds with many windows, whose windows and
    probes are dealt by a word too: with fewer mismatches than words one of them is equal, and a pair counts at its first
    equal word. So a hot seed is spread over 65,536 keys for each word, and no pair is lost. Runs know such seeds themselves.
    """
    if runs.is_packed(index):
        return _best_in_runs(probe, index) if best else _hits_in_runs(probe, index)
    i = index.select("seed", F.col("hi").alias("i_hi"), F.col("lo").alias("i_lo"), "gpos")
    distance = dna.packed_distance("hi", "i_hi") + dna.packed_distance("lo", "i_lo")

    def near(p: DataFrame, w: DataFrame, condition) -> DataFrame:
        return p.join(w, condition & (distance < dna.MISMATCHES)).select("rid", "strand", "attempt", "at", distance.alias("mismatches"), "gpos")

    if hot is None:
        return near(probe, i, probe["seed"] == i["seed"])
    by_word = lambda df, hi, lo, no, word: df.join(hot, "seed", "left_semi").select("*", F.posexplode(F.array(*_words(hi, lo))).alias(no, word))
    p, w = by_word(probe, "hi", "lo", "no", "word"), by_word(i, "i_hi", "i_lo", "i_no", "i_word")
    # Words before this one differ.
    first = F.lit(True)
    for k, (x, y) in enumerate(zip(_words("hi", "lo"), _words("i_hi", "i_lo"))):
        first = first & ((F.col("no") <= k) | (x != y))
    spread = near(p, w, (p["seed"] == w["seed"]) & (p["no"] == w["i_no"]) & (p["word"] == w["i_word"]) & first)
    cold_p, cold_i = probe.join(hot, "seed", "left_anti"), i.join(hot, "seed", "left_anti")
    return near(cold_p, cold_i, cold_p["seed"] == cold_i["seed"]).union(spread)


def first_match(found: DataFrame) -> DataFrame:
    """(rid, strand, attempt, at, mismatches, gpos, pos): the first successful probe of each read, forward before reverse; pos is where the read starts."""
    best = found.groupBy("rid").agg(F.min(F.struct("strand", "attempt", "mismatches", "gpos", "at")).alias("m"))
    return best.select("rid", "m.*").withColumn("pos", F.col("gpos") - F.col("at"))


def assign(reads: DataFrame, index: DataFrame, tries: int = TRIES, hot: DataFrame | None = None) -> DataFrame:
    if runs.is_packed(index):
        return first_match(hits(packed_probes(reads, tries), index, best=True))
    return first_match(hits(probes(reads, tries), index, hot))


def classified(reads: DataFrame, placed: DataFrame) -> DataFrame:
    """reads with cls (0 placed, 1 not placed, 2 has N), pos and is_fwd."""
    out = reads.join(placed.select("rid", "pos", "strand"), "rid", "left")
    cls = F.when(dna.has_n("seq"), 2).when(F.col("pos").isNull(), 1).otherwise(0)
    return out.withColumn("cls", cls).withColumn("is_fwd", F.coalesce(F.col("strand") == 0, F.lit(True))).drop("strand")


def canonical(reads: DataFrame) -> DataFrame:
    """Reads placed on the reverse strand as their reverse complement."""
    return reads.withColumn("seq", F.when(F.col("is_fwd"), F.col("seq")).otherwise(dna.reverse_complement("seq")))


restored = canonical
