"""Windows as runs: all of them, once, in bounded parts, and few bytes for each."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import assign, genome, runs


def _texts():
    rng = random.Random(21)
    some = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (700, 300, 54, 53, 0, 90)]
    return [*some, some[0][100:400], "A" * 200, "ACG" * 60, some[1][:100] + "N" + some[1][100:], some[1][:80] + "\u00e9\ufffd" + some[1][80:190], "acgtn" + some[2].lower(), "GT" * 90]


def _contigs(spark, texts):
    return genome.contigs(spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(texts)], "ord long, chrom string, seq string"))


def _plain(texts):
    """window: [places]"""
    out, off = {}, 0
    for s in texts:
        for i in range(len(s) - 53):
            w = s[i : i + 54].upper()
            if set(w) <= set("ACGT"):
                out.setdefault(w, []).append(off + i)
        off += len(s)
    return out


def _text(hi, lo):
    return "".join("ACGT"[x >> 2 * i & 3] for x in (int(hi), int(lo)) for i in range(26, -1, -1))


@pytest.mark.parametrize("part", [1 << 20, 100])
def test_runs_hold_every_window(monkeypatch, part):
    """Also in parts that are smaller than a group; no seed is in two of them."""
    monkeypatch.setattr(runs, "PART", part)
    texts = _texts()
    offsets = np.cumsum([0] + [len(s) for s in texts[:-1]]).tolist()
    rows = runs._cut([s.encode("ascii", "replace") for s in texts], offsets)
    got, seeds = Counter(), Counter()
    for pos, hi, lo in runs.windows_of(rows.column(1).to_pylist()):
        got.update((int(p), _text(a, b)) for p, a, b in zip(pos, hi, lo))
        seeds.update(set((lo & genome.SEED_MASK).tolist()))
    assert got == Counter((p, w) for w, places in _plain(texts).items() for p in places) and set(seeds.values()) == {1}
    for g, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        for _, _, lo in runs.windows_of([data]):
            assert set(runs.groups_of(lo & genome.SEED_MASK).tolist()) == {g}


def test_windows_of_one_mixture_are_told_apart(monkeypatch):
    """Windows that share the mixture by which they are sorted."""
    step = pow(0x9E3779B97F4A7C15, -1, 1 << 64) * 0xD1B54A32D192ED03 % (1 << 64)
    hi = np.array([5, 5 + step, 5, 5 + step, 5], np.uint64).view(np.int64)
    lo = np.array([9, 8, 9, 8, 9], np.int64)
    pos, a, b, n = runs.distinct(np.array([7, 3, 2, 1, 4]), hi, lo)
    assert sorted(zip(pos.tolist(), b.tolist(), n.tolist())) == [(1, 8, 2), (2, 9, 3)]


def test_copies_by_runs(spark):
    texts = _texts()
    want = Counter()
    for places in _plain(texts).values():
        want[len(places), "windows"] += 1
        want[len(places), "places"] += min(places)
    got = runs.copies(runs.of_genome(_contigs(spark, texts))).collect()
    assert {(r.copies, k): r[k] for r in got for k in ("windows", "places")} == want


def test_few_bytes_travel_for_a_window(spark):
    """Rows of single windows took 28 bytes each."""
    rng = random.Random(22)
    index = runs.of_genome(_contigs(spark, ["".join(rng.choice("ACGT") for _ in range(300_000))]))
    assert index.agg(F.sum(F.length("runs"))).first()[0] < 7 * 300_000


def _found(hits):
    return sorted((r.rid, r.strand, r.attempt, r.at, r.mismatches, r.gpos) for r in hits.collect())


@pytest.mark.parametrize("many", [64, 2])
def test_hits_in_runs_are_those_in_windows(spark, monkeypatch, tmp_path, many):
    """Rows, counts and best hits, with and without storing; windows of one seed, variants, copies and repeats among them."""
    rng = random.Random(23)
    base = "".join(rng.choice("ACGT") for _ in range(54))
    near = lambda s, n: "".join(rng.choice("ACGT") if i in set(rng.sample(range(40), n)) else b for i, b in enumerate(s))
    texts = [*_texts(), *(near(base, rng.randrange(8)) for _ in range(40))]
    reads = [(i, "ACGTAC" + near(base, rng.randrange(5)) + "GATTACAT") for i in range(30)] + [(100 + i, texts[0][7 * i : 7 * i + 100]) for i in range(40)]
    reads_ = spark.createDataFrame([*reads, (200, "GT" * 50), (201, "ACG" * 30), (202, "N" * 80), (203, "ACGT")], "rid long, seq string")
    ctg = _contigs(spark, texts)
    snps = genome.located(spark.createDataFrame([(0, "c0", 50, "A"), (1, "c1", 120, "G"), (2, "c6", 60, "T")], "ord long, chrom string, pos long, alt string"), ctg)
    alternate = genome.alternate_windows(ctg, snps)
    rows, index = genome.distinct_windows(genome.windows(ctg), alternate), runs.of_genome(ctg, alternate)
    probe = assign.probes(reads_)
    want = _found(assign.hits(probe, rows))
    if many != 64:  # in this process, since tasks read the module anew
        p = np.array([(r.rid, r.strand, r.attempt, r["at"], r.hi, r.lo) for r in probe.collect()], assign.PROBE)
        monkeypatch.setattr(assign, "MANY", many)
        monkeypatch.setattr(assign, "PAIRS", 5)
        w = rows.collect()
        got = [x for pi, wi, d in assign._near(p, np.array([r.hi for r in w]), np.array([r.lo for r in w])) for x in zip(pi, wi, d)]
        assert sorted((*(int(p[n][i]) for n in ("rid", "strand", "attempt", "at")), int(d), w[j].gpos) for i, j, d in got) == want
        return
    assert len(want) > 300 and _found(assign.hits(probe, index)) == want and _found(assign.hits(assign.packed_probes(reads_), index)) == want
    assert {(r.mismatches, r.strand): r.n for r in assign.hit_counts(assign.packed_probes(reads_), index).collect()} == Counter((m, s) for _, s, _, _, m, _ in want)
    placed = sorted(map(tuple, assign.assign(reads_, rows).collect()))
    path = str(tmp_path / "index")
    genome.store_index(index, path)
    for held in (index, genome.open_index(spark, path)):
        assert sorted(map(tuple, assign.assign(reads_, held).collect())) == placed


def test_a_stored_index_is_small(spark, tmp_path):
    """Rows of windows took 28 bytes; only probes are shuffled for a lookup."""
    rng = random.Random(24)
    text = "".join(rng.choice("ACGT") for _ in range(300_000))
    path = str(tmp_path / "index")
    genome.store_index(runs.of_genome(_contigs(spark, [text])), path)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    assert size < 8 * len(text)
    placed = assign.assign(spark.createDataFrame([(1, text[1000:1100])], "rid long, seq string"), genome.open_index(spark, path))
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(grp") == 1
    assert [(r.pos, r.mismatches) for r in placed.collect()] == [(1000, 0)]
