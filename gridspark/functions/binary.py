"""Numbers and texts out of binary columns, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .refs import let


def unsigned(data: Column, at: Column | int, size: int) -> Column:
    """Little-endian unsigned integer of up to 7 bytes at a place (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, at + 1, F.lit(size)))
    swapped = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))
    return F.conv(swapped, 16, 10).cast("long")


def double_of_bits(high: Column, low: Column) -> Column:
    """IEEE double whose upper and lower 32 bits are given as unsigned numbers; every step is exact."""

    def value(x: Column) -> Column:
        sign = F.when(x.h >= 1 << 31, -1.0).otherwise(1.0)
        exponent = F.shiftright(x.h, 20).bitwiseAND(F.lit(0x7FF))
        fraction = x.h.bitwiseAND(F.lit(0xFFFFF)) * 4294967296.0 + x.l
        normal = (1.0 + fraction / 4503599627370496.0) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
        small = fraction * 4.9406564584124654e-324
        special = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
        return sign * F.when(exponent == 0, small).when(exponent == 0x7FF, special).otherwise(normal)

    return let(F.struct(high.alias("h"), low.alias("l")), value)


def double(data: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return double_of_bits(unsigned(data, at + 4, 4), unsigned(data, at, 4))


def rk_hundredth(rk: Column) -> Column:
    return rk.bitwiseAND(F.lit(1)) == 1


def rk_integer(rk: Column) -> Column:
    """The signed 30-bit integer of a packed number, where it is one; an undivided or evenly divided one."""

    def value(v: Column) -> Column:
        n = F.shiftright(v, 2) - F.when(v >= 1 << 31, 1 << 30).otherwise(0)
        whole = F.when(~rk_hundredth(v), n).when(n % 100 == 0, (n / 100).cast("long"))
        return F.when(v.bitwiseAND(F.lit(2)) == 2, whole)

    return let(rk, value)


def rk_double(rk: Column) -> Column:
    """A packed number as a double."""

    def value(v: Column) -> Column:
        n = (F.shiftright(v, 2) - F.when(v >= 1 << 31, 1 << 30).otherwise(0)).cast("double")
        plain = F.when(v.bitwiseAND(F.lit(2)) == 2, n).otherwise(double_of_bits(v - v.bitwiseAND(F.lit(3)), F.lit(0).cast("long")))
        return F.when(rk_hundredth(v), plain / 100.0).otherwise(plain)

    return let(rk, value)


def wide_text(data: Column, at: Column | int) -> Column:
    """UTF-16 text behind its 32-bit length; null where the length says so."""
    at = F.lit(at) if isinstance(at, int) else at
    n = unsigned(data, at, 4)
    return let(n, lambda k: F.when(k < 0xFFFFFFFF, F.decode(F.substring(data, (at + 5).cast("int"), (2 * k).cast("int")), "UTF-16LE")))
