"""Sources, index, placing, archives and the command line."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.operators import archive, assign, genome, reads
from strandframe.sources import fastx
from strandframe.streaming import ingest

RC = str.maketrans("ACGT", "TGCA")


def _genome():
    rng = random.Random(7)
    return {n: "".join(rng.choice("ACGT") for _ in range(size)) for n, size in (("one", 3000), ("two", 1500), ("tiny", 20))}


def _mutated(rng, s, places):
    out = list(s)
    for p in places:
        out[p] = rng.choice([b for b in "ACGT" if b != out[p]])
    return "".join(out)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("fastx")
    g, rng = _genome(), random.Random(8)
    with gzip.open(d / "genome.fa.gz", "wt") as f:
        for name, seq in g.items():
            f.write(f">{name} a comment\r\n")
            f.writelines(seq[i : i + 60].lower() + "\r\n" for i in range(0, len(seq), 60))
    every = {}
    for name, n in (("a.1.fq", 40), ("b.2.fq.gz", 30), ("none.fq", 0)):
        out = []
        for k in range(n):
            seq = g[rng.choice(["one", "two"])]
            at = rng.randrange(len(seq) - 101)
            s = seq[at : at + rng.choice([68, 100, 101])]
            if k % 3 == 1:
                s = s.translate(RC)[::-1]
            if k % 5 == 2:
                s = _mutated(rng, s, [rng.randrange(len(s)) for _ in range(3)])
            if k % 7 == 3:
                s = s[:10] + "N" + s[11:]
            if k == 9:
                s = "acgtx" * 20
            if k == 11:
                s = "ACGT" * 10
            out.append(s)
        text = "".join(f"@r{i} x\n{s[:50]}\n{s[50:]}\n+\n{'@' * len(s)}\n" for i, s in enumerate(out))
        (gzip.open if name.endswith("gz") else open)(d / name, "wt").write(text)
        every[name] = out
    return d, g, every


def test_parser_agrees_between_readers(spark, files):
    d, _, every = files
    paths = [str(d / n) for n in every]
    a = fastx.read_fastx(spark, paths, local=False).orderBy("file_ord", "rec_no").collect()
    b = fastx.read_fastx(spark, paths, local=True).orderBy("file_ord", "rec_no").collect()
    assert a == b and [r.seq for r in a] == [s for out in every.values() for s in out]
    assert a[0].name == "r0" and a[0].comment == "x" and a[0].qual == "@" * len(a[0].seq)


def test_bad_quality_is_an_error():
    import io

    with pytest.raises(ValueError):
        list(fastx.parse(io.BytesIO(b"@r\nACGT\n+\nII\n")))
    assert list(fastx.parse(io.BytesIO(b"junk\n>x\nAC\nGT\n>y z\n"))) == [("x", "", "ACGT", None), ("y", "z", "", None)]


def test_ordinals_have_no_gaps(spark, files):
    d, _, every = files
    got = fastx.with_ordinals(fastx.read_fastx(spark, [str(d / n) for n in every])).orderBy("rid").collect()
    assert [r.rid for r in got] == list(range(70)) and [r.seq for r in got] == [s for out in every.values() for s in out]


def test_windows(spark):
    g = _genome()
    ctg = genome.contigs(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(g.items())], "ord long, chrom string, seq string"))
    got = {(r.gpos, r.w) for r in genome.windows(ctg).select("gpos", genome.window_text().alias("w")).collect()}
    want, off = set(), 0
    for s in g.values():
        want |= {(off + i, s[i : i + 54]) for i in range(len(s) - 53)}
        off += len(s)
    assert got == want


def test_windows_combined_in_batches(spark):
    g = {"a": "ACGT" * 40 + "A" * 100, "b": "A" * 70, "c": "ACGT" * 20}
    ctg = genome.contigs(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(g.items())], "ord long, chrom string, seq string").coalesce(1))
    plain = {(r.hi, r.lo): (r.p, r.n) for r in genome.windows(ctg).groupBy("hi", "lo").agg(F.min("gpos").alias("p"), F.count("*").alias("n")).collect()}
    once = genome.windows(ctg, once=True)
    assert {(r.hi, r.lo): (r.p, r.n) for r in once.groupBy("hi", "lo").agg(F.min("gpos").alias("p"), F.sum("n").alias("n")).collect()} == plain
    assert once.count() < sum(n for _, n in plain.values()) and genome.windows(ctg.where("ctg_ord > 5"), once=True).collect() == []


def test_long_contigs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(genome, "PIECE", 100)
    s = _genome()["one"][:777]
    ctg = genome.contigs(spark.createDataFrame([(0, "x", s)], "ord long, chrom string, seq string"))
    assert sorted(r.gpos for r in genome.windows(ctg).collect()) == list(range(len(s) - 53))


def test_variant_windows(spark):
    s = _genome()["one"][:200]
    ctg = genome.contigs(spark.createDataFrame([(0, "x", s)], "ord long, chrom string, seq string"))
    snps = genome.located(spark.createDataFrame([(0, "x", 5, "A"), (1, "x", 5, "C"), (2, "x", 120, "G"), (3, "y", 1, "A"), (4, "x", 500, "A")], "ord long, chrom string, pos long, alt string"), ctg)
    got = {(r.gpos, r.w) for r in genome.alternate_windows(ctg, snps).select("gpos", genome.window_text().alias("w")).collect()}
    want = set()
    for p, alt in ((5, "A"), (120, "G")):
        t = s[:p] + alt + s[p + 1 :]
        want |= {(i, t[i : i + 54]) for i in range(max(0, p - 53), min(p, len(s) - 54) + 1)}
    assert got == want


@pytest.mark.parametrize("wrong, found", [(4, True), (5, False)])
def test_mismatch_bound(spark, wrong, found):
    rng, s = random.Random(9), _genome()["one"]
    index = genome.distinct_windows(genome.windows(genome.contigs(spark.createDataFrame([(0, "x", s)], "ord long, chrom string, seq string"))))
    read = s[500:568]  # one probe per strand, at 6
    read = _mutated(rng, read, [6 + 2 * i for i in range(wrong)])
    rows = assign.assign(spark.createDataFrame([(1, read)], "rid long, seq string"), index).collect()
    assert [(r.pos, r.strand, r.mismatches) for r in rows] == ([(500, 0, 4)] if found else [])


@pytest.mark.parametrize("limit", [0, 3])
def test_hot_seeds_lose_no_pair(spark, limit):
    """Windows that share a seed, with 0 to 7 differing bases before it."""
    rng = random.Random(10)
    base = [rng.choice("ACGT") for _ in range(54)]
    contigs, reads_ = [], []
    for i in range(60):
        w = _mutated(rng, base, rng.sample(range(40), rng.randrange(0, 8)))
        contigs.append((i, f"c{i}", w if i % 4 else "".join(rng.choice("ACGT") for _ in range(54))))
        reads_.append((i, "ACGTAC" + _mutated(rng, base, rng.sample(range(40), rng.randrange(0, 5))) + "GATTACAT"))
    index = genome.distinct_windows(genome.windows(genome.contigs(spark.createDataFrame(contigs, "ord long, chrom string, seq string"))))
    probe = assign.probes(spark.createDataFrame(reads_, "rid long, seq string"))
    plain = sorted(tuple(r) for r in assign.hits(probe, index).collect())
    hot = genome.hot_seeds(index, limit)
    assert sorted(tuple(r) for r in assign.hits(probe, index, hot).collect()) == plain and len(plain) > 300
    kept = assign.index_of(probe, genome.contigs(spark.createDataFrame(contigs, "ord long, chrom string, seq string")))
    assert sorted(tuple(r) for r in assign.hits(probe, kept).collect()) == plain and kept.count() <= index.count()


def test_probe_offsets():
    assert assign.probe_offsets(67) == [] and assign.probe_offsets(68) == [6] and assign.probe_offsets(100) == [10, 23, 36] and len(assign.probe_offsets(69)) == 2


def test_round_trip(spark, files, tmp_path):
    d, g, every = files
    snps = tmp_path / "snps.tsv"
    snps.write_text("rs1\tone\t100\tA\nrs2 two 50 C\n")
    cli.build_index(spark, [str(d / "genome.fa.gz")], str(tmp_path / "idx"), str(snps))
    paths = [str(d / n) for n in every]
    cli.encode_files(spark, str(tmp_path / "idx"), paths, str(tmp_path / "arc"), 64 << 20)
    blocks = spark.read.parquet(str(tmp_path / "arc/blocks"))
    assert {r.cls for r in blocks.collect()} == {0, 1, 2}
    got = archive.decode(spark, str(tmp_path / "arc")).orderBy("rid").collect()
    assert [r.seq for r in got] == [s for out in every.values() for s in out]
    assert [r.name for r in got] == [n for n, out in every.items() for _ in out]
    cli.decode_archive(spark, str(tmp_path / "arc"), str(tmp_path / "out"))
    for name in ("a.1.fq", "b.2.fq.gz"):
        stem = name.rpartition(".")[0]
        text = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"file={stem}").glob("part-*")))
        assert text.split() == every[name]


def test_damage_is_an_error(spark, files, tmp_path):
    _, g, _ = files
    rows = [(i, 0, g["one"][i : i + 100]) for i in range(20)]
    reads_ = spark.createDataFrame(rows, "rid long, file_ord int, seq string")
    index = genome.distinct_windows(genome.windows(genome.contigs(spark.createDataFrame([(0, "x", g["one"])], "ord long, chrom string, seq string"))))
    path = str(tmp_path / "arc")
    archive.encode(reads_, index, path, {0: "a.fq"})
    spark.read.parquet(f"{path}/files").withColumn("crc64", F.lit("0")).coalesce(1).write.parquet(f"{path}/files2")
    spark.read.parquet(f"{path}/files2").write.mode("overwrite").parquet(f"{path}/files")
    with pytest.raises(ValueError):
        archive.decode(spark, path)
    bad = spark.read.parquet(f"{path}/blocks").withColumn("payload", F.unhex(F.regexp_replace(F.hex("payload"), "^(.{40}).{4}", "$1FFFF")))
    with pytest.raises(Exception):
        archive.unpack(bad).collect()


def test_small_blocks_are_refused(spark):
    with pytest.raises(ValueError):
        archive.encode(spark.createDataFrame([], "rid long, file_ord int, seq string"), None, "x", block_bases=1 << 20)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["encode", "-i", "x", "-o", "y", "-b", "16M", "f"])


def test_blocks_are_cut_by_bases(spark):
    df = spark.createDataFrame([(0, 0, 0, i, "ACGT" * 5) for i in range(10)], "cls int, pos long, rev int, rid long, seq string").coalesce(1)
    assert [r.n for r in archive.cut_blocks(df, 60).orderBy("block").collect()] == [2, 2, 2, 2, 2]


def test_checksums_follow_order(spark):
    from strandframe.functions import codecs

    rows = [(f, i, "ACGT"[i % 4] * (i + 1)) for f in (0, 1) for i in range(30)]
    want = {str(f): f"{codecs.crc_fold([(codecs.crc_part(''.join(s for g, _, s in rows if g == f).encode()), sum(len(s) for g, _, s in rows if g == f))]):016x}" for f in (0, 1)}
    got = reads.checksums(spark.createDataFrame(rows, "file_ord int, rid long, seq string").repartition(7))
    assert {r.file_ord: r.crc64 for r in got.collect()} == want


def test_headers_are_checked():
    from pyspark.sql import Row

    good = Row(version=archive.VERSION, block_bases=64 << 20, reads=3, bases=9, min_length=2, max_length=4)
    archive.check_header([good])
    for bad in ([], [good, good], [Row(**good.asDict() | {"version": "9.0.0"})], [Row(**good.asDict() | {"max_length": 1})], [Row(**good.asDict() | {"block_bases": 1 << 20})]):
        with pytest.raises(ValueError):
            archive.check_header(bad)


def test_sums_before_and_ranges(spark, monkeypatch):
    from strandframe.operators import prefix

    monkeypatch.setattr(prefix, "WIDTH", 3)
    rng = random.Random(5)
    keys = rng.sample(range(-50, 400), 120)
    rows = [(k, rng.randrange(5)) for k in keys]
    got = {r.k: r.before for r in prefix.sums_before(spark.createDataFrame(rows, "k long, n long"), "k", "n", "before").collect()}
    assert got == {k: sum(n for j, n in rows if j < k) for k in keys}
    ranges = [(i, a, a + rng.randrange(0, 40)) for i, a in enumerate(range(0, 400, 40))]
    points = spark.createDataFrame([(p,) for p in range(-3, 403)], "p long")
    held = {r.p: r.f for r in prefix.ranges_hold(points, "p", spark.createDataFrame(ranges, "f int, lo long, hi long"), 16, "left").collect()}
    assert held == {p: next((i for i, lo, hi in ranges if lo <= p < hi), None) for p in range(-3, 403)}


def test_uneven_lists_of_a_dump_are_an_error(spark):
    from strandframe.operators import snps

    rows = spark.createDataFrame([("rs1", "x", 3, ["A", "C"], ["0.5"], ["300", "200"], "A")], "rsid string, chrom string, start long, alleles array<string>, freqs array<string>, supports array<string>, ref string")
    with pytest.raises(Exception, match="differ in number"):
        snps.top_allele(rows).collect()


def test_reference_bases_at_piece_borders(spark):
    from strandframe.operators import snps

    seq = "ACGTTGCAAC"
    rows = spark.createDataFrame([(f"r{i}", "x", i) for i in range(-1, 12)] + [("q", "y", 0)], "rsid string, chrom string, start long")
    got = {r.rsid: r.ref for r in snps.with_reference(rows, spark.createDataFrame([("x", seq), ("z", "")], "chrom string, seq string"), 4).collect()}
    assert got == {f"r{i}": b for i, b in enumerate(seq)}


def test_streaming_places_arriving_files(spark, files, tmp_path):
    d, g, every = files
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("a.1.fq", "b.2.fq.gz"):
        (folder / n).write_bytes((d / n).read_bytes())
    index = genome.distinct_windows(genome.windows(genome.contigs(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(g.items())], "ord long, chrom string, seq string"))))
    q = ingest.place_arriving(spark, str(folder), index, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 70 and {r.cls for r in rows} == {0, 1, 2}


@pytest.mark.parametrize("k", [1, 5, 14, 31])
def test_kmer_counts(spark, k):
    from collections import Counter

    from strandframe.operators import kmers

    rng = random.Random(k)
    seqs = ["", "ACGT", None, "N" * 40] + ["".join(rng.choice("ACGNTACGTACGT") for _ in range(rng.randrange(20, 200))) for _ in range(30)]
    plain = Counter(s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1) if "N" not in s[i : i + k])
    both = Counter()
    for s, n in plain.items():
        both[min(s, s.translate(RC)[::-1])] += n
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert {r.kmer: r.n for r in kmers.counts(df, k).collect()} == plain
    assert {r.kmer: r.n for r in kmers.counts(df, k, canonical=True).collect()} == both


def test_spacing_of_variants(spark):
    from strandframe.operators import snps

    rng = random.Random(3)
    rows = [(c, p) for c in ("x", "y") for p in sorted(rng.sample(range(6000), 300))]
    want = []
    for c in ("x", "y"):
        last = None
        for d, p in rows:
            if d == c and (last is None or p - last > 54):
                want.append((c, p))
                last = p
    got = snps.spaced(spark.createDataFrame(rows, "chrom string, start long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
