"""Selection of variants from a dump."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna

SPACING = dna.WINDOW
#: Stretches without wide gaps that are walked by one call.
ISLANDS = 512
MIN_FREQUENCY, MIN_SUPPORT = 0.01, 100.0


def single_positions(rows: DataFrame) -> DataFrame:
    """Genomic single-base rows, the first of each (chrom, start) in input order."""
    fit = rows.where((F.col("mol_type") == "genomic") & (F.col("kind") == "single") & (F.col("end") == F.col("start") + 1))
    return fit.withColumn("_n", F.row_number().over(Window.partitionBy("chrom", "start").orderBy("ord"))).where("_n = 1").drop("_n")


def oriented(rows: DataFrame) -> DataFrame:
    """Alleles of rows on the minus strand complemented."""
    turned = F.transform("alleles", lambda a: F.when(F.length(a) == 1, F.translate(a, "ACGT", "TGCA")).otherwise(a))
    return rows.withColumn("alleles", F.when(F.col("strand") == "-", turned).otherwise(F.col("alleles")))


def with_reference(rows: DataFrame, contigs: DataFrame, width: int = 1 << 20) -> DataFrame:
    """rows with ref, the base at start of their chromosome; unknown chromosomes and places outside go.

    Contigs are cut into pieces of `width`; the rows of a piece meet it as one list, so no sequence is repeated for them.
    """
    n = F.length("seq")
    cut = contigs.where(n > 0).select("chrom", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).alias("_b"), "seq")
    cut = cut.select("chrom", F.col("_b").cast("long").alias("_b"), F.upper(F.substring("seq", F.col("_b") * width + 1, F.lit(width))).alias("_s"))
    held = rows.where("start >= 0").groupBy("chrom", F.floor(F.col("start") / width).alias("_b")).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    based = F.transform("_rows", lambda v: F.struct(v.alias("row"), F.substring(F.col("_s"), (v["start"] % width).cast("int") + 1, F.lit(1)).alias("ref")))
    return held.join(cut, ["chrom", "_b"]).select(F.explode(based).alias("_v")).select("_v.row.*", F.col("_v.ref").alias("ref")).where("ref <> ''")


def top_allele(rows: DataFrame) -> DataFrame:
    """rows with alt, the most frequent allele that may stand for the reference; ties keep the listed order; rows without one go."""
    known = rows.where((F.col("ref") != "N") & F.array_contains("alleles", F.col("ref")))
    n, even = F.size("alleles"), (F.size("alleles") == F.size("freqs")) & (F.size("alleles") == F.size("supports"))
    n = F.when(even, n).otherwise(F.raise_error(F.concat(F.lit("alleles, frequencies and supports differ in number: "), F.col("rsid"))).cast("int"))
    zipped = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((-F.get("freqs", i).cast("double")).alias("f"), i.alias("i"), F.get("alleles", i).alias("a"), F.get("supports", i).cast("double").alias("s"))))
    fit = F.filter(zipped, lambda z: z["a"].rlike("^[ACGT]$") & (z["a"] != F.col("ref")) & (-z["f"] >= MIN_FREQUENCY) & (z["s"] >= MIN_SUPPORT))
    return known.withColumn("alt", F.array_min(fit)["a"]).where("alt is not null")


def spaced(rows: DataFrame, distance: int = SPACING, width: int = 1 << 16) -> DataFrame:
    """Keeps a variant only if none that is kept lies within the preceding `distance` positions of its chromosome.

    The choice depends on earlier ones, but not across gaps of more than `distance`. Gaps are found within stretches of
    `width` positions, each beginning with the last variant of the one before; whole stretches between gaps are walked
    together, many of them by one call. Only a run without any gap must stay in one task.
    """
    cut = rows.withColumn("_b", F.floor(F.col("start") / width))
    ends = cut.groupBy("chrom", "_b").agg(F.max("start").alias("_last"))
    before = ends.select("chrom", "_b", F.lag("_last").over(Window.partitionBy("chrom").orderBy("_b")).alias("_before"))
    by = Window.partitionBy("chrom", "_b").orderBy("start")
    cut = cut.join(before, ["chrom", "_b"]).withColumn("_prior", F.coalesce(F.lag("start").over(by), F.col("_before")))
    cut = cut.withColumn("_new", F.coalesce((F.col("start") - F.col("_prior") > distance).cast("int"), F.lit(0)))
    sums = cut.groupBy("chrom", "_b").agg(F.sum("_new").alias("_n"))
    starts = sums.select("chrom", "_b", (F.sum("_n").over(Window.partitionBy("chrom").orderBy("_b")) - F.col("_n")).alias("_s"))
    run = Window.partitionBy("chrom", "_b").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_i", F.sum("_new").over(run)).join(starts, ["chrom", "_b"]).withColumn("_island", F.col("_s") + F.col("_i"))
    cut = cut.withColumn("_g", F.floor(F.col("_island") / ISLANDS))
    keys, columns = ["chrom", "_g", "start"], rows.columns

    def walk(batches):
        last = None
        for batch in batches:
            chrom, group, start = (batch.column(batch.schema.get_field_index(k)) for k in keys)
            kept, last = _walk(chrom.to_pylist(), np.asarray(group), np.asarray(start), distance, last)
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    # A group is a few hundred neighbouring stretches: the gap between two of them is too wide to matter. Groups of a
    # partition follow each other, and there may be very many: each chromosome has one.
    return cut.select(*columns, "_g").repartition("chrom", "_g").sortWithinPartitions(*keys).mapInArrow(walk, rows.schema)


def _walk(chrom: list, group: np.ndarray, start: np.ndarray, distance: int, last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Numbers of the rows that are kept, and (chrom, group, start) of the last one kept; last: that of the rows before."""
    if not len(start):
        return np.zeros(0, np.int64), last
    other = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | np.fromiter((a != b for a, b in zip(chrom[1:], chrom[:-1])), bool, len(chrom) - 1))])
    # Groups side by side on one axis, too far from each other to matter.
    edge = np.flatnonzero(np.diff(other, prepend=-1))
    end = np.append(edge[1:], len(start)) - 1
    shift = np.concatenate([[0], np.cumsum(start[end[:-1]] - start[edge[1:]] + distance + 1)])
    at = start + shift[other]
    follows = np.searchsorted(at, at + distance, "right").tolist()
    i = int(np.searchsorted(at, last[2] + distance, "right")) if last and last[:2] == (chrom[0], int(group[0])) else 0
    # A row of the last one's group that is too near; the next group begins with a row that is kept.
    if i and len(edge) > 1:
        i = min(i, int(edge[1]))
    kept = []
    while i < len(at):
        kept.append(i)
        i = follows[i]
    if kept:
        last = chrom[kept[-1]], int(group[kept[-1]]), int(start[kept[-1]])
    return np.array(kept, np.int64), last


def select_snps(rows: DataFrame, contigs: DataFrame, spacing: bool = True) -> DataFrame:
    """(rsid, chrom, pos, alt) chosen from parsed dump rows."""
    out = top_allele(oriented(with_reference(single_positions(rows), contigs))).select("rsid", "chrom", "start", "alt")
    return (spaced(out) if spacing else out).select("rsid", "chrom", F.col("start").alias("pos"), "alt")
