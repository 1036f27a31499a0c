"""Every registered query of the engine against its SQL twin, and the entry point."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from strandframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(cols, rows):
    return sorted(map(repr, ([r[c] for c in cols] for r in rows)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert cols == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert _rows(cols, [r.asDict() for r in got.collect()]) == _rows(cols, rows)


def test_checksum_query_against_a_register(spark):
    """One register over all bases of a file, bit by bit."""
    from strandframe.functions import codecs

    step = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ codecs.CRC_POLY if b & 1 else b >> 1
        step.append(b)
    want, letters = {}, {c: "ACGT"[i % 4].encode()[0] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        state = want.get(r.source or "", codecs.CRC_START)
        for c in (r.text or "").lower():
            if c in letters:
                state = step[(state ^ letters[c]) & 0xFF] ^ state >> 8
        want[r.source or ""] = state
    assert {r.file: r.crc64 for r in catalog.QUERIES["crc64_per_file"](spark, SF).collect()} == {f: f"{s:016x}" for f, s in want.items()}


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and (rows[0].kmer, rows[0].n) == ("AAAAAAAAAAAAAA", 330) and (rows[-1].kmer, rows[-1].n) == ("AAAATAAAAATAAA", 119)


def test_entry_names():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
