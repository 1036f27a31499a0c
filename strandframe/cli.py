"""index | encode | decode from the command line.

    python -m strandframe.cli index -o idx [-s snps.tsv] genome.fa.gz ...
    python -m strandframe.cli encode -i idx -o archive [-b 128M] [-n 3] [-p 6] reads.fq.gz ...
    python -m strandframe.cli decode -o folder [-g] archive
"""

from __future__ import annotations

import argparse
import logging
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import archive, genome, runs
from strandframe.sources import fastx, variants

log = logging.getLogger("strandframe")


def size_of(text: str) -> int:
    """Bytes of a size with a suffix M or G; no suffix means MiB."""
    m = re.fullmatch(r"(\d+)([MmGg]?)", text)
    if not m:
        raise argparse.ArgumentTypeError(f"{text!r} is not a size such as 128M or 1G")
    n = int(m[1]) << (30 if m[2] in ("G", "g") else 20)
    if not archive.MIN_BLOCK <= n <= archive.MAX_BLOCK:
        raise argparse.ArgumentTypeError(f"block size must be {archive.MIN_BLOCK >> 20}M to {archive.MAX_BLOCK >> 30}G")
    return n


def _number(low: int, high: int):
    def read(text: str) -> int:
        n = int(text)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"{n} is not within {low} to {high}")
        return n

    return read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-t", "--threads", type=_number(1, 4096), help="cores of a local session")
    common.add_argument("-v", "--verbose", action="store_true")
    common.add_argument("-l", "--list", action="store_true", help="the one input is a text file of paths")
    common.add_argument("inputs", nargs="+")
    index = sub.add_parser("index", parents=[common])
    index.add_argument("-o", "--output", required=True)
    index.add_argument("-s", "--snps")
    encode = sub.add_parser("encode", parents=[common])
    encode.add_argument("-i", "--index", required=True)
    encode.add_argument("-o", "--output", required=True)
    encode.add_argument("-b", "--block", type=size_of, default=archive.DEFAULT_BLOCK)
    encode.add_argument("-n", "--tries", type=_number(1, 1000), default=3)
    encode.add_argument("-p", "--preset", type=_number(0, 9), default=6)
    decode = sub.add_parser("decode", parents=[common])
    decode.add_argument("-o", "--output", required=True)
    decode.add_argument("-g", "--gzip", action="store_true")
    return top


def build_index(spark: SparkSession, paths: list[str], out: str, snps: str | None = None) -> None:
    """Writes ref_contig, snp and ref_window; runs of windows are bucketed by the groups of their seeds."""
    if len(set(paths)) != len(paths):
        raise ValueError("genome paths must be unique")
    records = fastx.read_fastx(spark, paths).where(F.length("seq") > 0)
    # Records in file order: a file has fewer than 2**40 of them.
    named = records.select((F.col("file_ord").cast("long") * (1 << 40) + F.col("rec_no")).alias("ord"), F.col("name").alias("chrom"), "seq")
    genome.contigs(named).write.mode("overwrite").parquet(f"{out}/ref_contig")
    ctg = spark.read.parquet(f"{out}/ref_contig")
    alternate = None
    if snps:
        genome.located(variants.read_snps(spark, snps), ctg).write.mode("overwrite").parquet(f"{out}/snp")
        alternate = genome.alternate_windows(ctg, spark.read.parquet(f"{out}/snp"))
    genome.store_index(runs.of_genome(ctg, alternate), f"{out}/ref_window")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return genome.open_index(spark, f"{path}/ref_window")


def encode_files(spark: SparkSession, index: str, paths: list[str], out: str, block: int = archive.DEFAULT_BLOCK, tries: int = 3, preset: int = 6) -> None:
    names = [os.path.basename(p) for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("input files must have different names")
    # Reads are numbered once and stored: the encoder goes over them for placing, order and checksums.
    fastx.with_ordinals(fastx.read_fastx(spark, paths)).write.mode("overwrite").parquet(f"{out}/.reads")
    reads = spark.read.parquet(f"{out}/.reads")
    hot = genome.stored_hot_seeds(spark, f"{index}/ref_window")
    archive.encode(reads, load_index(spark, index), out, dict(enumerate(names)), block, preset, tries, hot)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/.reads")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def decode_archive(spark: SparkSession, path: str, out: str, gzip: bool = False) -> None:
    decoded = archive.decode(spark, path)
    stems = [re.sub(r"\.[^.]*$", "", r.name) for r in spark.read.parquet(f"{path}/files").select("name").collect()]
    if len(set(stems)) != len(stems):
        raise ValueError("two inputs would be written under the same name")
    archive.write_decoded(decoded, out, gzip)


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files").orderBy("file_ord")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    builder = SparkSession.builder.appName(f"strandframe-{args.command}")
    if args.threads:
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    paths = args.inputs
    if args.list:
        if len(paths) != 1:
            raise SystemExit("one list file is expected")
        paths = fastx.path_list(spark, paths[0])
    if args.command == "index":
        build_index(spark, paths, args.output, args.snps)
    elif args.command == "encode":
        encode_files(spark, args.index, paths, args.output, args.block, args.tries, args.preset)
        if args.verbose:
            summary(spark, args.output).show(truncate=False)
    else:
        if len(paths) != 1:
            raise SystemExit("one archive is expected")
        decode_archive(spark, paths[0], args.output, args.gzip)
    return 0


if __name__ == "__main__":
    sys.exit(main())
