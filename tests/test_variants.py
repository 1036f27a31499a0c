"""Spacing of variants and the windows around them, many at a time."""

import random

import numpy as np
import pytest

from strandframe.operators import genome, snps


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_rows_are_walked_in_batches_of_many_groups(size):
    """A call for each chromosome took ten milliseconds, however few rows it had."""
    rng = random.Random(size)
    rows = []
    for c in "abcdefgh":
        at = 0
        for g in range(rng.randrange(1, 4)):
            for _ in range(rng.randrange(1, 30)):
                rows.append((c, g, at))
                at += rng.choice((0, 1, 20, 54, 55, 60))
            at += 500
    want, last = [], None
    for c, g, at in rows:
        if last is None or last[:2] != (c, g) or at - last[2] > 54:
            want.append((c, g, at))
            last = c, g, at
    got, last = [], None
    for i in range(0, len(rows), size):
        chrom, group, start = (list(x) for x in zip(*rows[i : i + size]))
        kept, last = snps._walk(chrom, np.array(group), np.array(start), 54, last)
        got += [rows[i + k] for k in kept]
    assert got == want and snps._walk([], np.zeros(0, int), np.zeros(0, int), 54, last)[1] == last


def test_spacing_makes_no_call_for_a_chromosome(spark):
    rows = spark.createDataFrame([(f"c{i}", 10 * j) for i in range(300) for j in range(7)], "chrom string, start long")
    got = snps.spaced(rows)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"c{i}", s) for i in range(300) for s in (0, 60))


def test_windows_of_many_variants_are_one_batch(spark):
    """Each contig was cut whole and its 54 windows were a batch by themselves."""
    rng = random.Random(51)
    texts = ["".join(rng.choice("ACGT" * 40 + "N") for _ in range(rng.choice((40, 54, 60, 300)))) for _ in range(60)]
    ctg = genome.contigs(spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(texts)], "ord long, chrom string, seq string").coalesce(1))
    listed, want, off = [], set(), 0
    for i, s in enumerate(texts):
        for p in {0, len(s) // 2, len(s) - 1}:
            alt = rng.choice("ACGT")
            listed.append((len(listed), f"c{i}", p, alt))
            t = s[:p] + alt + s[p + 1 :]
            want |= {(off + k, t[k : k + 54]) for k in range(max(0, p - 53), min(p, len(s) - 54) + 1) if "N" not in s[k : k + 54]}
        off += len(s)
    located = genome.located(spark.createDataFrame(listed, "ord long, chrom string, pos long, alt string"), ctg)
    rows = genome.alternate_windows(ctg, located).select("gpos", genome.window_text().alias("w")).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == sum(1 for r in genome.alternate_windows(ctg, located, text=True).collect() if (r.gpos, r.w) in want)


def test_letters_become_bases_once(spark):
    """Windows of variants go over the contigs several times."""
    from strandframe.plans import catalog

    plan = catalog.QUERIES["snp_overlay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan
