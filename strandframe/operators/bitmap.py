"""Set algebra over DataFrames of one long column `x`, and compact bitmaps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix import sums_before

#: Values that share a chunk, and the most that a chunk holds as a list.
CHUNK, LISTED = 1 << 16, 4096


def of_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("x")).where("x is not null").distinct()


def of_range(spark: SparkSession, lo: int, hi: int, step: int = 1) -> DataFrame:
    return spark.range(lo, hi, step).select(F.col("id").alias("x"))


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "x", "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "x", "left_anti")


def symmetric_difference(*sets: DataFrame) -> DataFrame:
    """Values in an odd number of the sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.groupBy("x").agg(F.count("*").alias("n")).where("n % 2 = 1").select("x")


def add(a: DataFrame, values: DataFrame) -> DataFrame:
    return union(a, values)


def remove(a: DataFrame, values: DataFrame) -> DataFrame:
    return subtract(a, values)


def flip(a: DataFrame, lo: int, hi: int) -> DataFrame:
    """a with membership turned round for lo <= x < hi."""
    span = of_range(a.sparkSession, lo, hi)
    return a.where(~((F.col("x") >= lo) & (F.col("x") < hi))).union(subtract(span, a))


def counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, n_and, n_or, n_xor, n_andnot, jaccard, is_subset, is_strict_subset, equals, intersects."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "x", "full")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_and"), F.count("*").alias("n_or"))
    return n.select("*", (F.col("n_or") - F.col("n_and")).alias("n_xor"), (F.col("n_a") - F.col("n_and")).alias("n_andnot"), F.when(F.col("n_or") == 0, 1.0).otherwise(F.col("n_and") / F.col("n_or")).alias("jaccard"), (F.col("n_and") == F.col("n_a")).alias("is_subset"), ((F.col("n_and") == F.col("n_a")) & (F.col("n_a") < F.col("n_b"))).alias("is_strict_subset"), (F.col("n_or") == F.col("n_and")).alias("equals"), (F.col("n_and") > 0).alias("intersects"))


def ranked(a: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(x, rank): how many values are <= x; numbered within stretches of values, which start at the sum of those before."""
    cut = a.withColumn("_b", F.floor(F.col("x") / width))
    starts = sums_before(cut.groupBy("_b").agg(F.count("*").alias("_n")), "_b", "_n", "_s").select("_b", "_s")
    return cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("x"))).join(starts, "_b").select("x", (F.col("_s") + F.col("_r")).cast("long").alias("rank"))


def select(a: DataFrame, ranks: list[int]) -> DataFrame:
    """(rank, x): values by rank from 0."""
    return ranked(a).where((F.col("rank") - 1).isin(ranks)).select((F.col("rank") - 1).alias("rank"), "x")


def contains_range(a: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: whether all of lo <= x < hi are in a, and how many."""
    n = a.where((F.col("x") >= lo) & (F.col("x") < hi)).agg(F.count("*").alias("n"))
    return n.select("n", (F.col("n") == hi - lo).alias("contained"))


def page(a: DataFrame, offset: int, limit: int) -> DataFrame:
    """`limit` values in order from the offset-th on."""
    return ranked(a).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select("x")


def compact(a: DataFrame) -> DataFrame:
    """(bucket, bits, n): 32,768 values to a bitmap row."""
    return a.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).withColumn("n", F.bitmap_count("bits"))


def compact_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("bucket", "bits").union(b.select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def compact_and(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("bucket"), "bucket", "left_semi").select("bucket", "bits").union(b.join(a.select("bucket"), "bucket", "left_semi").select("bucket", "bits"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def following(a: DataFrame, start: int, n: int) -> DataFrame:
    """The first n values from start on, in order: an iterator that was moved to start."""
    return a.where(F.col("x") >= start).orderBy("x").limit(n)


def preceding(a: DataFrame, start: int, n: int) -> DataFrame:
    """The last n values up to start, in falling order."""
    return a.where(F.col("x") <= start).orderBy(F.desc("x")).limit(n)


def in_batches(a: DataFrame, size: int) -> DataFrame:
    """(batch, first, last, n): the values in order, `size` at a time."""
    cut = ranked(a).withColumn("batch", F.floor((F.col("rank") - 1) / size))
    return cut.groupBy("batch").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("n"))


def statistics(a: DataFrame) -> DataFrame:
    """One row: chunks of 65,536 values, kept as a list or as bits, with the values in each kind, their least, greatest and sum."""
    chunks = a.groupBy(F.floor(F.col("x") / CHUNK).alias("chunk")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
    listed = F.col("n") <= LISTED
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return chunks.agg(
        F.count("*").alias("chunks"), count(F.when(listed, 1)).alias("list_chunks"), count(F.when(~listed, 1)).alias("bit_chunks"), count(F.when(listed, F.col("n"))).alias("in_lists"), count(F.when(~listed, F.col("n"))).alias("in_bits"),
        count(F.col("n")).alias("cardinality"), F.min("lo").alias("least"), F.max("hi").alias("greatest"), F.coalesce(F.sum("total"), F.lit(0)).cast("string").alias("total"),
    )
