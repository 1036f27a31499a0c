"""Bit functions over 64-bit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _l(v: int) -> Column:
    """A 64-bit literal from an unsigned value."""
    return F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long")


def _bit(i: Column | int) -> Column:
    return F.expr("1L") if isinstance(i, int) and i == 0 else F.call_function("shiftleft", _l(1), (F.lit(i) if isinstance(i, int) else i).cast("int"))


def test_bit(x, i) -> Column:
    return _c(x).bitwiseAND(_bit(i)) != 0


def set_bit(x, i) -> Column:
    return _c(x).bitwiseOR(_bit(i))


def clear_bit(x, i) -> Column:
    return _c(x).bitwiseAND(F.bitwise_not(_bit(i)))


def change_bit(x, i) -> Column:
    return _c(x).bitwiseXOR(_bit(i))


def copy_bit(x, src: int, dst: int) -> Column:
    """x with bit dst set to bit src."""
    return F.when(test_bit(x, src), set_bit(x, dst)).otherwise(clear_bit(x, dst))


def swap_bits(x, i: int, j: int) -> Column:
    return F.when(test_bit(x, i) != test_bit(x, j), change_bit(change_bit(x, i), j)).otherwise(_c(x))


def swap_unequal_bits(x, i: int, j: int) -> Column:
    """swap_bits for bits that are known to differ: both change."""
    return _c(x).bitwiseXOR(_l((1 << i) ^ (1 << j)))


def block(p: int, n: int) -> Column:
    """n ones from bit p on."""
    return _l((((1 << n) - 1) << p) & ((1 << 64) - 1))


def mask(n: int) -> Column:
    return block(0, n)


def popcount(x) -> Column:
    return F.bit_count(_c(x))


def count_low_ones(x) -> Column:
    """Ones of a word that is 0..01..1."""
    return F.when(_c(x) == 0, 0).otherwise(floor_log2(x) + 1)


def parity(x) -> Column:
    return F.bit_count(_c(x)) % 2


def swap_groups(x, width: int) -> Column:
    """Exchanges neighbouring groups of 1, 2, 4, 8, 16 or 32 bits."""
    low = sum(((1 << width) - 1) << p for p in range(0, 64, 2 * width))
    x = _c(x)
    return F.shiftleft(x.bitwiseAND(_l(low)), width).bitwiseOR(F.shiftrightunsigned(x, width).bitwiseAND(_l(low)))


def swap_bytes(x) -> Column:
    return swap_groups(swap_groups(swap_groups(x, 8), 16), 32)


def rotate_left(x, n: int) -> Column:
    return F.shiftleft(_c(x), n).bitwiseOR(F.shiftrightunsigned(_c(x), 64 - n)) if n % 64 else _c(x)


def rotate_right(x, n: int) -> Column:
    return rotate_left(x, (64 - n) % 64)


def lowest_one(x) -> Column:
    """x & -x; -x is written as ~(x - 1) by bits, since the smallest long has no negative."""
    return _c(x).bitwiseAND(F.bitwise_not(_minus_one(_c(x))))


def _minus_one(x: Column) -> Column:
    """x - 1 that wraps round."""
    return F.when(x == _l(1 << 63), _l((1 << 63) - 1)).otherwise(x - 1)


def _plus_one(x: Column) -> Column:
    return F.when(x == _l((1 << 63) - 1), _l(1 << 63)).otherwise(x + 1)


def _wrapping_add(x: Column, y: Column) -> Column:
    """64-bit sum that wraps round, from the halves."""
    low = x.bitwiseAND(_l(0xFFFFFFFF)) + y.bitwiseAND(_l(0xFFFFFFFF))
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_l(0xFFFFFFFF)))


def lowest_one_index(x) -> Column:
    """Index of the lowest one; 0 for 0."""
    return F.when(_c(x) == 0, 0).otherwise(F.bit_count(_minus_one(lowest_one(x))))


def lowest_zero(x) -> Column:
    return lowest_one(F.bitwise_not(_c(x)))


def clear_lowest_one(x) -> Column:
    return _c(x).bitwiseAND(_minus_one(_c(x)))


def set_lowest_zero(x) -> Column:
    return _c(x).bitwiseOR(_plus_one(_c(x)))


def floor_log2(x) -> Column:
    """Exact floor of log2, 0 for 0; x counts as unsigned."""
    return F.greatest(F.length(F.bin(_c(x))) - 1, F.lit(0))


highest_one_index = floor_log2


def highest_one(x) -> Column:
    return F.when(_c(x) == 0, _l(0)).otherwise(_bit(floor_log2(x)))


def highest_zero(x) -> Column:
    return highest_one(F.bitwise_not(_c(x)))


def highest_zero_index(x) -> Column:
    """Index of the highest zero; 0 if there is none."""
    return highest_one_index(F.bitwise_not(_c(x)))


def set_highest_zero(x) -> Column:
    return _c(x).bitwiseOR(highest_zero(x))


def is_power_of_2(x) -> Column:
    """True for 0 too."""
    return clear_lowest_one(x) == 0


def is_one_bit(x) -> Column:
    return (_c(x) != 0) & is_power_of_2(x)


def next_exponent_of_2(x) -> Column:
    """Smallest e with 2**e >= x, which counts as unsigned."""
    return F.when(_c(x).isin(0, 1), 0).otherwise(floor_log2(_minus_one(_c(x))) + 1)


def next_power_of_2(x) -> Column:
    """Smallest power of 2 that is not below x; 0 for 0 and beyond 2**63."""
    e = next_exponent_of_2(x)
    return F.when((_c(x) == 0) | (e > 63), _l(0)).otherwise(_bit(e))


def nth_one_index(x, i: int) -> Column:
    """Index of the i-th one from below, from 0; -1 if there are fewer."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit(_c(x), p) == 1)
    return F.coalesce(F.get(ones, F.lit(i)), F.lit(-1))


def same_highest_one(x, y) -> Column:
    """Whether floor(log2) of both is the same; 0 has it in common with itself only."""
    return (floor_log2(x) == floor_log2(y)) & ((_c(x) == 0) == (_c(y) == 0))


def other_highest_one(x, y) -> Column:
    return ~same_highest_one(x, y)


def average(x, y) -> Column:
    """Floor of the mean without overflow; both count as unsigned."""
    return _wrapping_add(_c(x).bitwiseAND(_c(y)), F.shiftrightunsigned(_c(x).bitwiseXOR(_c(y)), 1))


def ceil_average(x, y) -> Column:
    return _wrapping_add(_c(x).bitwiseOR(_c(y)), _plus_one(F.bitwise_not(F.shiftrightunsigned(_c(x).bitwiseXOR(_c(y)), 1))))


def is_even(x) -> Column:
    return _c(x).bitwiseAND(_l(1)) == 0


def is_odd(x) -> Column:
    return _c(x).bitwiseAND(_l(1)) != 0


def random_index(m: Column | int, seed: int | None = None) -> Column:
    """A uniform number from 0 to m - 1 for each row."""
    return F.floor(F.rand(seed) * m).cast("long")
