"""Reversible filters for numeric columns: delta, delta of delta, XOR with the value before, byte planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def line(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def delta(c: Column, over: WindowSpec) -> Column:
    """c less the value before; the first keeps its value. Sums of 64-bit values wrap."""
    return c - F.coalesce(F.lag(c, 1).over(over), F.lit(0))


def undelta(c: Column, over: WindowSpec) -> Column:
    return F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, 0))


def xor_prev(c: Column, over: WindowSpec) -> Column:
    return c.bitwiseXOR(F.coalesce(F.lag(c, 1).over(over), F.lit(0)))


def unxor(df: DataFrame, c: str, over: WindowSpec, name: str) -> DataFrame:
    """df with the running XOR of c."""
    return df.withColumn(name, F.bit_xor(c).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def byte_plane(c: Column, plane: int) -> Column:
    """Byte `plane` (0 lowest) of an integer."""
    return F.shiftrightunsigned(c.cast("long"), 8 * plane).bitwiseAND(F.lit(255)).cast("int")


def from_planes(planes: list[Column], kind: str = "int") -> Column:
    """The integer that byte planes (lowest first) were taken from: the inverse of byte_plane over all of the type's bytes."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(planes):
        out = out.bitwiseOR(F.shiftleft(p.cast("long"), 8 * i))
    bits = 8 * len(planes)
    return (out if bits == 64 else F.when(out >= F.lit(1 << bits - 1), out - F.lit(1 << bits)).otherwise(out)).cast(kind)
