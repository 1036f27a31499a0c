"""The window index: contigs, windows, variant overlay, distinct windows, seed groups.

Windows travel as two 27-base codes and a seed code, packed by numpy over whole
contigs in Arrow batches: one multiply-add per base instead of a substring per window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import dna

from .prefix import sums_before

HALF = dna.WINDOW // 2
#: Pieces that long contigs are cut into; neighbours overlap by a window less one.
PIECE = 1 << 20

_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def contigs(records: DataFrame) -> DataFrame:
    """(ctg_ord, chrom, offset, length, seq): sequences in upper case with their place in the concatenation.

    records: ord, chrom, seq. Of a repeated name the first is kept for lookups by name; all stay in the concatenation.
    """
    # One row per contig: the running sum is over contig lengths, without their sequences.
    place = sums_before(records.select("ord", F.length("seq").cast("long").alias("length")), "ord", "length", "offset")
    return records.join(place, "ord").select(F.col("ord").alias("ctg_ord"), "chrom", "offset", "length", F.upper("seq").alias("seq"))


def pieces(ctg: DataFrame) -> DataFrame:
    """Contigs cut into overlapping pieces, so that one contig is spread over tasks: (ctg_ord, piece, offset, seq)."""
    n = F.length("seq")
    starts = F.sequence(F.lit(0), F.greatest(n - dna.WINDOW, F.lit(0)), F.lit(PIECE))
    cut = ctg.where(n >= dna.WINDOW).select("ctg_ord", "offset", F.explode(starts).alias("at"), "seq")
    return cut.select("ctg_ord", F.floor(F.col("at") / PIECE).alias("piece"), (F.col("offset") + F.col("at")).alias("offset"), F.substring("seq", F.col("at") + 1, F.lit(PIECE + dna.WINDOW - 1)).alias("seq"))


def codes(seq: np.ndarray, k: int) -> np.ndarray:
    """Base-4 code of each k-mer of an array of base codes, by doubling."""
    out, have, size = None, seq.astype(np.int64), 1
    at, rest = 0, k
    n = len(seq) - k + 1
    while rest:
        if rest & 1:
            part = have[at : at + n]
            out = part.copy() if out is None else out << (2 * size) | part
            at += size
        rest >>= 1
        if rest:
            have = have[:-size] << (2 * size) | have[size:]
            size *= 2
    return out


def _packed(seq: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first half, second half) of the windows of a sequence that hold A, C, G, T only."""
    c = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(c) - dna.WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    bad = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c > 3, out=bad[1:])
    ok = np.flatnonzero(bad[dna.WINDOW :] == bad[:n])
    half = codes(c & 3, HALF)
    return ok, half[ok], half[ok + HALF]


SEED_MASK = (1 << 2 * dna.SEED) - 1


WINDOW_SCHEMA = "gpos long, hi long, lo long, seed int"


def _window_rows(pos: list[np.ndarray], hi: list[np.ndarray], lo: list[np.ndarray]) -> pa.RecordBatch:
    cat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (pos, hi, lo)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cat), pa.array((cat[2] & SEED_MASK).astype(np.int32))], ["gpos", "hi", "lo", "seed"])


def _combined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows of a batch once each, with their smallest place and n, how often they are there."""
    pos, hi, lo = (np.asarray(batch.column(i)) for i in range(3))
    mixed = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(mixed, kind="stable")
    a, b = hi[order], lo[order]
    # Windows that are not next to each other for a shared mixture stay apart: they are met again behind the shuffle.
    edge = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    first, n = order[edge], np.diff(np.concatenate([edge, [len(a)]]))
    least = np.minimum.reduceat(pos[order], edge) if len(a) else pos
    return pa.RecordBatch.from_arrays([pa.array(least), pa.array(hi[first]), pa.array(lo[first]), batch.column(3).take(pa.array(first)), pa.array(n.astype(np.int64))], ["gpos", "hi", "lo", "seed", "n"])


def windows(ctg: DataFrame, seeds: bytes | None = None, once: bool = False) -> DataFrame:
    """(gpos, hi, lo, seed) of every window of a contig that holds A, C, G, T only; windows do not cross contigs.

    seeds: a bitmap of seed_bitmap(); windows with other seeds are not made into rows. once: equal windows of a batch are one
    row with their number n, so that a repeat does not travel as often as it stands in the genome.
    """
    sent = ctg.sparkSession.sparkContext.broadcast(seeds) if seeds is not None else None

    def run(batches):
        wanted = np.frombuffer(sent.value, np.uint8) if sent is not None else None
        shape = _combined if once else lambda batch: batch
        for batch in batches:
            pos, hi, lo, n = [], [], [], 0
            for offset, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, a, b = _packed(seq.encode("ascii", "replace"))
                if wanted is not None:
                    seed = b & SEED_MASK
                    some = np.flatnonzero(wanted[seed >> 3] >> (seed & 7).astype(np.uint8) & 1)
                    at, a, b = at[some], a[some], b[some]
                pos.append(at + offset)
                hi.append(a)
                lo.append(b)
                n += len(at)
                if n > 1 << 20:
                    yield shape(_window_rows(pos, hi, lo))
                    pos, hi, lo, n = [], [], [], 0
            yield shape(_window_rows(pos, hi, lo))

    return pieces(ctg).select("offset", "seq").mapInArrow(run, WINDOW_SCHEMA + (", n long" if once else ""))


def seed_bitmap(rows: DataFrame) -> bytes:
    """A bit for each of the 4**14 seeds, set where `rows` has it: 32 MiB at most, whatever the number of rows.

    Put together by the executors, 32,768 seeds to a row.
    """
    held = rows.select((F.col("seed").cast("long") + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out, step = bytearray((SEED_MASK + 1) // 8), 4096
    for r in held.collect():
        out[(r.bucket - 1) * step : r.bucket * step] = r.bits
    return bytes(out)


def located(snps: DataFrame, ctg: DataFrame) -> DataFrame:
    """(gpos, alt, ctg_ord, pos): variants on the global axis and in their contig; unknown chromosomes are dropped, the first of a position is kept.

    snps: ord, chrom, pos (from 0), alt.
    """
    first = ctg.groupBy("chrom").agg(F.min_by(F.struct("offset", "length", "ctg_ord"), "ctg_ord").alias("c"))
    at = snps.join(first, "chrom").where((F.col("pos") >= 0) & (F.col("pos") < F.col("c.length")))
    at = at.select("ord", (F.col("c.offset") + F.col("pos")).alias("gpos"), "alt", F.col("c.ctg_ord").alias("ctg_ord"), "pos")
    return at.groupBy("gpos").agg(F.min_by(F.struct("alt", "ctg_ord", "pos"), "ord").alias("v")).select("gpos", "v.*")


def alternate_windows(ctg: DataFrame, snps: DataFrame, text: bool = False) -> DataFrame:
    """(gpos, hi, lo, seed) of the windows that cover a variant, with its base in place; one variant per window. text: (gpos, w).

    Variants go to the pieces of their contig in which such windows start, one list for each piece, and only these windows
    are cut, those of many variants at once. snps: located().
    """
    digit = F.instr(F.lit("ACGT"), F.col("alt")) - 1
    first, last = F.greatest(F.col("pos") - (dna.WINDOW - 1), F.lit(0)), F.col("pos")
    asked = snps.where(F.col("alt").rlike("^[ACGT]$")).select("ctg_ord", "gpos", digit.cast("int").alias("digit"), F.explode(F.array_distinct(F.array(F.floor(first / PIECE), F.floor(last / PIECE)))).alias("piece"))
    asked = asked.groupBy("ctg_ord", "piece").agg(F.collect_list(F.struct("gpos", "digit")).alias("variants"))
    piece = PIECE

    def run(batches):
        held = []
        for batch in batches:
            for offset, seq, variants in zip(*(c.to_pylist() for c in batch.columns)):
                for v in variants:
                    place = v["gpos"] - offset
                    # A piece makes the windows that start in its first PIECE bases.
                    least, most = max(0, place - dna.WINDOW + 1), min(place, len(seq) - dna.WINDOW, piece - 1)
                    if least <= most:
                        held.append((seq[least : most + dna.WINDOW], offset + least, place - least, v["digit"]))
                        if len(held) >= VARIANTS:
                            yield made(held)
                            held = []
        if held:
            yield made(held)

    def made(held):
        pos, hi, lo = _changed(*zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(pos), _texts(hi, lo)], ["gpos", "w"]) if text else _window_rows([pos], [hi], [lo])

    return pieces(ctg).join(asked, ["ctg_ord", "piece"]).select("offset", "seq", "variants").mapInArrow(run, "gpos long, w string" if text else WINDOW_SCHEMA)


#: Variants whose windows are cut at once.
VARIANTS = 1 << 13


def _changed(around: tuple[str, ...], start: tuple[int, ...], within: tuple[int, ...], digit: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first half, second half) of the windows of the bases around variants, with the variant's base in place."""
    begin = np.cumsum([0] + [len(s) + 1 for s in around[:-1]])
    at, hi, lo = _packed("N".join(around).encode("ascii", "replace"))
    of = np.searchsorted(begin, at, "right") - 1
    at = at - begin[of]
    off, base = np.array(within, np.int64)[of] - at, np.array(digit, np.int64)[of]
    shift = 2 * (HALF - 1 - off % HALF)
    changed = np.where(off < HALF, hi, lo) & ~(np.int64(3) << shift) | base << shift
    return np.array(start, np.int64)[of] + at, np.where(off < HALF, changed, hi), np.where(off < HALF, lo, changed)


def _texts(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """window_text() of many windows."""
    letters, shift = np.frombuffer(b"ACGT", np.uint8), np.arange(2 * HALF - 2, -1, -2)
    grid = np.concatenate([letters[x[:, None] >> shift & 3] for x in (hi, lo)], axis=1)
    ends = np.arange(len(hi) + 1, dtype=np.int32) * dna.WINDOW
    return pa.StringArray.from_buffers(len(hi), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(grid)))


def distinct_windows(plain: DataFrame, alternate: DataFrame | None = None) -> DataFrame:
    """(hi, lo, seed, is_alt, gpos): each distinct window once; the reference goes before a variant, then the smallest place.

    Windows are dealt by seed, which serves lookups by seed as well.
    """
    # Flag and place in one long, so the minimum is a hash aggregation: the top bit but one is the flag.
    flag = 1 << 62
    every = plain.select("seed", "hi", "lo", F.col("gpos").alias("p"))
    if alternate is not None:
        every = every.union(alternate.select("seed", "hi", "lo", F.col("gpos").bitwiseOR(F.lit(flag)).alias("p")))
    least = every.repartition("seed").groupBy("seed", "hi", "lo").agg(F.min("p").alias("p"))
    return least.select("hi", "lo", "seed", (F.col("p") >= flag).alias("is_alt"), F.col("p").bitwiseAND(F.lit(flag - 1)).alias("gpos"))


#: Seeds with more distinct windows than this are looked up by a word as well.
HOT_SEED = 4096


def hot_seeds(index: DataFrame, limit: int = HOT_SEED) -> DataFrame:
    """(seed) of the seeds with more than `limit` windows; of a stored index no row is moved for it."""
    return index.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("seed")


def store_index(index: DataFrame, path: str, buckets: int | None = None) -> None:
    """Writes runs, or distinct windows, bucketed and sorted by group or seed, so that a lookup moves the probes alone; the number of buckets beside them, and the hot seeds of windows."""
    spark = index.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"windows_{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    packed = "runs" in index.columns
    key = "grp" if packed else "seed"
    rows = index.select(*(["grp", "runs"] if packed else ["seed", "hi", "lo", "is_alt", "gpos"])).repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{path}/windows").saveAsTable(name)
    if not packed:
        hot_seeds(spark.table(name)).coalesce(1).write.mode("overwrite").parquet(f"{path}/hot")
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(buckets, packed)], "buckets int, runs boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index as a bucketed table, declared under the same name for the same path."""
    layout = spark.read.parquet(f"{path}/layout").first().asDict()
    buckets, packed = layout["buckets"], layout.get("runs", False)
    name = f"windows_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    key, columns = ("grp", "grp INT, runs BINARY") if packed else ("seed", "seed INT, hi BIGINT, lo BIGINT, is_alt BOOLEAN, gpos BIGINT")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/windows'")
    return spark.table(name)


def stored_hot_seeds(spark: SparkSession, path: str) -> DataFrame | None:
    """The hot seeds of a stored index, None if it has none or knows them itself."""
    if spark.read.parquet(f"{path}/layout").first().asDict().get("runs", False):
        return None
    hot = spark.read.parquet(f"{path}/hot")
    return None if hot.isEmpty() else hot


def window_text(hi="hi", lo="lo"):
    return F.concat(dna.kmer_text(hi, HALF), dna.kmer_text(lo, HALF))


def seed_groups(index: DataFrame) -> DataFrame:
    """(seed, n): distinct windows of each seed."""
    return index.groupBy("seed").agg(F.count("*").alias("n"))


def distinct_per_seed(plain: DataFrame) -> DataFrame:
    """(seed, n) straight from windows: dealt by seed once, which serves the distinct windows and their count."""
    return seed_groups(plain.select("seed", "hi", "lo").repartition("seed").distinct())


def bucket_histogram(groups: DataFrame) -> DataFrame:
    """(size, seeds): how many seeds have 1 .. 256 windows; larger ones count as 257."""
    return groups.select(F.least("n", F.lit(257)).cast("long").alias("size")).groupBy("size").agg(F.count("*").alias("seeds"))


def first_ranks(groups: DataFrame, key: str, n: str) -> DataFrame:
    """groups with `first_rank`: running count of rows before a key, a long, in key order."""
    return sums_before(groups, key, n, "first_rank")
