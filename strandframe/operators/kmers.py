"""K-mer counts.

K-mers are coded by numpy over whole sequences and counted by tasks, so a shuffle sees
packed codes with counts; text is made for the final rows only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna

from .genome import codes
from .tally import tally


def code_counts(sequences: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(code, n) of the k-mers of the column seq; those with other letters than A, C, G, T are left out. k is at most 31.

    canonical: a k-mer and its reverse complement count as the smaller of both.
    """

    def codes_of(c: np.ndarray) -> np.ndarray:
        if len(c) < k:
            return np.zeros(0, np.int64)
        bad = np.zeros(len(c) + 1, np.int32)
        np.cumsum(c > 3, out=bad[1:])
        c = c & 3
        code = codes(c, k)
        if canonical:
            # The reverse complement's k-mers stand in the opposite order.
            code = np.minimum(code, codes(3 - c[::-1], k)[::-1])
        return code[bad[k:] == bad[: len(code)]]

    return tally(sequences.select(F.coalesce("seq", F.lit("")).cast("binary").alias("seq")), codes_of, 2 * k)


def counts(sequences: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(kmer, n): code_counts() as text."""
    return code_counts(sequences, k, canonical).select(dna.kmer_text("code", k).alias("kmer"), "n")


def top(sequences: DataFrame, k: int, n: int, canonical: bool = True) -> DataFrame:
    """The n most frequent k-mers; ties go to the smaller."""
    return code_counts(sequences, k, canonical).orderBy(F.desc("n"), "code").limit(n).select(dna.kmer_text("code", k).alias("kmer"), "n")
