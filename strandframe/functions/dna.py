"""Nucleotide functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Window, seed and word count of the index, mismatches from which a window is no hit, shortest read that is placed.
WINDOW, SEED, WORDS, MISMATCHES, MIN_READ = 54, 14, 5, 5, 68
#: The letters of reads in order, and what each pairs with.
LETTERS, PAIRS = "ACGNT", "TGCNA"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_base(b: Column | str) -> Column:
    """A, C, G or T in either case."""
    return _c(b).rlike("^[ACGTacgt]$")


def is_base_or_n(b: Column | str) -> Column:
    return _c(b).rlike(f"^[{LETTERS}{LETTERS.lower()}]$")


def has_n(s: Column | str) -> Column:
    """Whether any base is N; other letters are not."""
    return _c(s).rlike("[Nn]")


def only_bases(s: Column | str) -> Column:
    return _c(s).rlike("^[ACGT]+$")


def long_enough(s: Column | str) -> Column:
    return F.length(_c(s)) >= MIN_READ


def complement(s: Column | str) -> Column:
    return F.translate(_c(s), LETTERS + LETTERS.lower(), PAIRS + PAIRS)


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(complement(s))


def reverse_complement_in_place(s: Column | str) -> Column:
    """The in-place variant, which leaves the middle base of odd lengths as it is (in upper case)."""
    s = _c(s)
    n = F.length(s)
    middle = F.upper(F.substring(s, (n / 2).cast("int") + 1, F.lit(1)))
    rc = reverse_complement(s)
    return F.when(n % 2 == 1, F.concat(F.substring(rc, F.lit(1), (n / 2).cast("int")), middle, F.substring(rc, (n / 2).cast("int") + 2, n))).otherwise(rc)


def kmer_id(kmer: Column | str) -> Column:
    """Base-4 code, first base most significant; null unless 1 to 31 bases A, C, G, T."""
    s = _c(kmer)
    return F.when(s.rlike("^[ACGTacgt]{1,31}$"), F.conv(F.translate(s, "ACGTacgt", "01230123"), 4, 10).cast("long"))


def kmer_text(code: Column | str, k: int) -> Column:
    """Inverse of kmer_id."""
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reversed_id(kmer: Column | str) -> Column:
    """Code of the reversed string, not complemented: the order of the window index."""
    return kmer_id(F.reverse(_c(kmer)))


def rc_id(kmer: Column | str) -> Column:
    return kmer_id(reverse_complement(kmer))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def min_id(kmer: Column | str, k: int) -> Column:
    """Code of a k-mer or of its reverse complement by the older rule: the latter if it is smaller at any place, not only at the first that differs."""
    s, rc = _c(kmer), reverse_complement(kmer)
    some = F.exists(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(s, i, F.lit(1)) > F.substring(rc, i, F.lit(1)))
    return F.when(some, kmer_id(rc)).otherwise(kmer_id(s))


def next_id(code: Column | str, base: Column | str, k: int) -> Column:
    """Code after the window moves one base to the right."""
    return F.shiftleft(_c(code), 2).bitwiseOR(_c(base)).bitwiseAND(F.lit((1 << (2 * k)) - 1 if k < 32 else -1).cast("long"))


def prev_id(code: Column | str, base: Column | str, k: int) -> Column:
    """Code after the window moves one base to the left."""
    return F.shiftrightunsigned(_c(code), 2).bitwiseOR(F.shiftleft(_c(base).cast("long"), 2 * k - 2))


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers of a sequence, as an array; empty for shorter ones."""
    s = _c(s)
    n = F.length(s) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def packed_distance(a: Column | str, b: Column | str) -> Column:
    """Bases in which two 27-base codes differ."""
    d = _c(a).bitwiseXOR(_c(b))
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x15555555555555).cast("long")))


def compare_reversed(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1: order of two windows compared from the right."""
    x, y = F.reverse(_c(a)), F.reverse(_c(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def substituted(window: Column | str, alt: Column | str, offset: Column | str) -> Column:
    """Window with the base at offset (from 0) replaced."""
    return F.overlay(_c(window), _c(alt), _c(offset) + 1, F.lit(1))
