"""Column helpers for arrays and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(array: Column | str, i: int) -> Column:
    """Element ``i`` (1-based, negative from the end), null where the array is shorter."""
    return F.try_element_at(array, F.lit(i))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean(array: Column) -> Column:
    return F.when(F.size(array) > 0, total(array) / F.size(array))


def var_pop(array: Column) -> Column:
    m = mean(array)
    return F.when(F.size(array) > 0, F.aggregate(F.transform(array, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / F.size(array))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def softplus(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def sure(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on values only, so samples don't change with partitioning."""
    digest = F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


UNIT_HASH_SQL = "(('0x' || substr(md5(concat_ws('|', {0}, '{1}')), 1, 8))::BIGINT / 4294967296.0)"


def unit_normal(*columns: Column | str, seed: int = 0) -> Column:
    """A standard normal number that depends on values only: two ``unit_hash`` numbers through the polar form of Box and Muller."""
    u, v = unit_hash(*columns, seed=2 * seed), unit_hash(*columns, seed=2 * seed + 1)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def unit_normal_sql(columns: str, seed: int = 0) -> str:
    u, v = UNIT_HASH_SQL.format(columns, 2 * seed), UNIT_HASH_SQL.format(columns, 2 * seed + 1)
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"
