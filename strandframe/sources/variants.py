"""Variant lists and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Layout of a dump: columns by position from the left; the last four are read from the right.
DUMP = ("bin", "chrom", "start", "end", "rsid", "score", "strand", "ref_ncbi", "ref_ucsc", "observed", "mol_type", "kind")


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """(ord, rsid, chrom, pos, alt) of a list with white-space separated columns; ord follows the lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 4)
    return lines.select("ord", F.col("p")[0].alias("rsid"), F.col("p")[1].alias("chrom"), F.col("p")[2].cast("long").alias("pos"), F.upper(F.substring(F.col("p")[3], 1, 1)).alias("alt"))


def parse_dump(lines: DataFrame) -> DataFrame:
    """Rows of a tab-separated dump (columns ord, value); blank lines and comments are skipped.

    Trailing columns: if the last one is a list of frequencies, frequencies, alleles and
    supports are columns -1, -3, -2; otherwise -2, -4, -3.
    """
    p = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("ord", F.split("value", "\t").alias("p")).where(F.size("p") >= 12)
    last = F.element_at("p", -1)
    # Fixed value: the pattern of a list of frequencies.
    plain = last.rlike(r"^([01]\.\d+?,){2,}$")
    pick = lambda a, b: F.when(plain, F.element_at("p", a)).otherwise(F.element_at("p", b))
    parts = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    cols = [F.col("p")[i].alias(n) for i, n in enumerate(DUMP)]
    return p.select("ord", *cols, parts(pick(-1, -2)).alias("freqs"), parts(pick(-3, -4)).alias("alleles"), parts(pick(-2, -3)).alias("supports")).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_dump(spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value"))


def plain_chrom(c):
    """Chromosome name without "chr", and MT for M."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def write_snps(snps: DataFrame, path: str) -> None:
    snps.select("rsid", "chrom", "pos", "alt").write.mode("overwrite").csv(path, sep="\t")


def first_per_position(snps: DataFrame) -> DataFrame:
    """The first row in input order of each (chrom, pos)."""
    return snps.withColumn("_n", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("ord"))).where("_n = 1").drop("_n")
