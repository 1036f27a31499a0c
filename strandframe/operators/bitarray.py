"""Arrays of bits as tables of the positions that are set (a long column `x`), within a length that the caller keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap


def test(bits: DataFrame, positions: DataFrame) -> DataFrame:
    """(x, is_set) of the positions asked for."""
    asked = positions.select("x").distinct()
    return asked.join(bits.withColumn("_set", F.lit(True)), "x", "left").select("x", F.coalesce("_set", F.lit(False)).alias("is_set"))


def change(bits: DataFrame, positions: DataFrame) -> DataFrame:
    """The positions turned round."""
    return bitmap.symmetric_difference(bits, positions.select("x").distinct())


#: Setting and clearing are union and difference; a test before them is test() on the same positions.
set_all = bitmap.union
clear_all = bitmap.subtract


def resized(bits: DataFrame, length: int) -> DataFrame:
    """Bits from length on are gone; new ones are clear."""
    return bits.where((F.col("x") >= 0) & (F.col("x") < length))


def summary(bits: DataFrame, length: int) -> DataFrame:
    """One row: ones, zeros, all_set, all_clear, first_set and first_clear (length, if there is none)."""
    ranked = bitmap.ranked(resized(bits, length))
    # Up to the first gap a value is one less than its rank.
    n = ranked.agg(F.count("*").alias("ones"), F.min("x").alias("lo"), F.count(F.when(F.col("x") == F.col("rank") - 1, 1)).alias("run"))
    return n.select("ones", (F.lit(length) - F.col("ones")).alias("zeros"), (F.col("ones") == length).alias("all_set"), (F.col("ones") == 0).alias("all_clear"), F.coalesce("lo", F.lit(length)).cast("long").alias("first_set"), F.col("run").alias("first_clear"))


def next_set(bits: DataFrame, start: int, length: int) -> DataFrame:
    """One row: the first set position from start on, or length."""
    return resized(bits, length).where(F.col("x") >= start).agg(F.coalesce(F.min("x"), F.lit(length)).cast("long").alias("next_set"))


def next_clear(bits: DataFrame, start: int, length: int) -> DataFrame:
    """One row: the first clear position from start on, or length."""
    ranked = bitmap.ranked(resized(bits, length).where(F.col("x") >= start))
    return ranked.agg((F.lit(start) + F.count(F.when(F.col("x") == F.col("rank") - 1 + start, 1))).cast("long").alias("next_clear"))
