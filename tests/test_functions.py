"""Scalar functions against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import bits, codecs, dna

RC = str.maketrans("ACGNT", "TGCNA")


def _id(s):
    out = 0
    for c in s:
        out = out * 4 + "ACGT".index(c)
    return out


def test_sequences(spark):
    rng = random.Random(1)
    seqs = ["", "A", "ACG", "N"] + ["".join(rng.choice("ACGNT") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", dna.reverse_complement("s"), dna.reverse_complement_in_place("s"), dna.has_n("s"), dna.kmers("s", 3)).collect()
    for s, rc, odd, n, kmers in got:
        want = s.translate(RC)[::-1]
        assert rc == want
        half = len(s) // 2
        assert odd == (want[:half] + s[half] + want[half + 1 :] if len(s) % 2 else want)
        assert n == ("N" in s)
        assert kmers == [s[i : i + 3] for i in range(len(s) - 2)]


def test_codes(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(11)) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("id", dna.kmer_id("s"))
    for s, i, text, rev, rc, nxt, prv in df.select("s", "id", dna.kmer_text("id", 11), dna.reversed_id("s"), dna.rc_id("s"), dna.next_id("id", F.lit(2).cast("long"), 11), dna.prev_id("id", F.lit(1), 11)).collect():
        assert (i, text, rev, rc) == (_id(s), s, _id(s[::-1]), _id(s.translate(RC)[::-1]))
        assert (nxt, prv) == (_id(s[1:] + "G"), _id("C" + s[:-1]))
    assert spark.createDataFrame([("ACGN",), ("",)], "s string").select(dna.kmer_id("s")).collect() == [(None,), (None,)]


def test_distance(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(50):
        a = [rng.choice("ACGT") for _ in range(27)]
        b = [c if rng.random() < 0.8 else rng.choice("ACGT") for c in a]
        rows.append(("".join(a), "".join(b), sum(x != y for x, y in zip(a, b))))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    assert df.where(dna.packed_distance(dna.kmer_id("a"), dna.kmer_id("b")) != F.col("d")).count() == 0


def test_bits(spark):
    rng = random.Random(4)
    values = [0, 1, 2, 3, 5, 8, -1, -(1 << 63), (1 << 63) - 1] + [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    cols = [bits.floor_log2("x"), bits.lowest_one_index("x"), bits.swap_bytes("x"), bits.rotate_left("x", 13), bits.rotate_right("x", 13), bits.nth_one_index("x", 1), bits.is_power_of_2("x"), bits.copy_bit("x", 3, 60), bits.swap_bits("x", 1, 62), bits.average("x", F.lit(7).cast("long"))]
    for v, log, low, swapped, left, right, second, power, copied, exchanged, mean in df.select("x", *cols).collect():
        u = v & (1 << 64) - 1
        ones = [i for i in range(64) if u >> i & 1]
        assert log == (ones[-1] if ones else 0) and low == (ones[0] if ones else 0)
        assert swapped & (1 << 64) - 1 == int.from_bytes(u.to_bytes(8, "big"), "little")
        assert left & (1 << 64) - 1 == (u << 13 | u >> 51) & (1 << 64) - 1
        assert right & (1 << 64) - 1 == (u >> 13 | u << 51) & (1 << 64) - 1
        assert second == (ones[1] if len(ones) > 1 else -1)
        assert power == (len(ones) <= 1)
        assert copied & (1 << 64) - 1 == u & ~(1 << 60) | (u >> 3 & 1) << 60
        a, b = u >> 1 & 1, u >> 62 & 1
        assert exchanged & (1 << 64) - 1 == u & ~(1 << 1 | 1 << 62) | b << 1 | a << 62
        assert mean & (1 << 64) - 1 == (u + 7) // 2


def test_powers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "x long")
    assert [tuple(r) for r in df.select(bits.next_power_of_2("x"), bits.highest_one("x")).collect()] == [(0, 0), (1, 1), (2, 2), (4, 2), (4, 4), (8, 4), (1024, 512), (1024, 1024), (2048, 1024)]


def _serial(data, c=codecs.CRC_START):
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ codecs.CRC_POLY if c & 1 else c >> 1
    return c


@settings(deadline=None, max_examples=30)
@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=5))
def test_checksum_combines(data, cuts):
    at = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    parts = [data[a:b] for a, b in zip(at, at[1:])]
    assert codecs.crc_fold([(codecs.crc_part(p), len(p)) for p in parts]) == _serial(data)


def test_checksum_of_long_data():
    data = bytes(random.Random(5).choice(b"ACGT") for _ in range(20_011))
    assert codecs.crc_fold([(codecs.crc_part(data), len(data))]) == _serial(data)


def test_keys_and_lzma(spark):
    df = spark.createDataFrame([(0, ""), (1, "ACGT" * 99), (1 << 39, "N"), (None, None)], "x long, s string")
    rows = df.select("x", codecs.from_big_endian(codecs.big_endian_key("x")), "s", codecs.lzma_decode(codecs.lzma_encode(3)("s")).cast("string")).collect()
    assert all(a == b and s == t for a, b, s, t in rows)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.one_of(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 1000)), max_size=700))
def test_packed_integers(values):
    import numpy as np

    data = codecs.pack_integers(np.array(values, np.int64))
    assert codecs.unpack_integers(data).tolist() == values
    for bad in (data + b"x", data[:-1] if len(data) > 4 else b"\x01\0\0\0"):
        try:
            assert codecs.unpack_integers(bad).tolist() != values
        except ValueError:
            pass


def test_packed_ordinals_are_small():
    import numpy as np

    assert len(codecs.pack_integers(np.arange(100_000))) < 100_000 * 0.3


def test_unsigned_exponents(spark):
    values = [0, 1, 2, 3, (1 << 62) + 1, (1 << 63) - 1, -(1 << 63), -(1 << 63) + 1, -1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = [tuple(r) for r in df.select(bits.next_exponent_of_2("x"), bits.next_power_of_2("x"), bits.set_highest_zero("x"), bits.highest_zero_index("x"), bits.count_low_ones("x")).collect()]
    for v, (e, power, filled, at, _) in zip(values, got):
        u = v & (1 << 64) - 1
        assert e == (u - 1).bit_length() * (u > 1)
        assert power & (1 << 64) - 1 == (0 if not u or e > 63 else 1 << e)
        zeros = [i for i in range(64) if not u >> i & 1]
        assert at == (zeros[-1] if zeros else 0) and filled & (1 << 64) - 1 == (u | (1 << zeros[-1] if zeros else 0))


def test_compatible_min_id(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGT") for _ in range(7)) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for s, got in df.select("s", dna.min_id("s", 7)).collect():
        rc = s.translate(RC)[::-1]
        assert got == _id(rc if any(a > b for a, b in zip(s, rc)) else s)
