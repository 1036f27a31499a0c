"""Counting codes in ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import genome, kmers, runs, tally


@pytest.mark.parametrize("width", [1, 200, 60_000, 1 << 30, 1 << 40])
def test_packed_codes(width):
    rng = random.Random(width)
    code = np.cumsum([rng.randrange(1, width + 1) for _ in range(300)])
    n = np.array([rng.randrange(1, 1 + min(width, 1 << 33)) for _ in range(300)])
    got = tally.unpack(tally.pack(code, n))
    assert np.array_equal(got[0], code) and np.array_equal(got[1], n)
    assert [len(x) for x in tally.unpack(tally.pack(code[:0], n[:0]))] == [0, 0]


def test_few_bytes_travel_for_a_kmer(spark, monkeypatch):
    """Codes went as rows of 16 bytes and more."""
    rng = random.Random(41)
    df = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(400_000)),)], "seq string")
    sent = []
    monkeypatch.setattr(tally, "dealt", lambda rows: sent.append(rows) or runs.dealt(rows))
    assert kmers.counts(df, 14, canonical=True).agg(F.sum("n")).first()[0] == 400_000 - 13
    assert sent[0].agg(F.sum(F.length("codes"))).first()[0] < 5 * 400_000


def test_batches_are_cut_by_size():
    """All sequences of an Arrow batch were windows at once."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["ACGT" * 25] * 40)], ["seq"])] * 3
    got = [len(seqs) for (seqs,) in runs.chunked(batches, 1000)]
    assert got == [10] * 12


def test_windows_are_counted(spark):
    rng = random.Random(42)
    texts = ["".join(rng.choice("ACGT" * 30 + "N") for _ in range(n)) for n in (0, 20, 53, 54, 400, 3000)]
    ctg = genome.contigs(spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(texts)], "ord long, chrom string, seq string"))
    whole = [s[i : i + 54] for s in texts for i in range(len(s) - 53) if "N" not in s[i : i + 54]]
    assert tally.window_count(ctg).first().made == len(whole) and tally.window_count(ctg.where("ctg_ord < 0")).first().made == 0
    seeds = {r.seed: r.n for r in tally.seed_counts(ctg).collect()}
    want = {}
    for w in whole:
        code = int(w[-14:].translate(str.maketrans("ACGT", "0123")), 4)
        want[code] = want.get(code, 0) + 1
    assert seeds == want
