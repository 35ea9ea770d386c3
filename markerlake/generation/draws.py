"""Random draws as column expressions: each is a hash of a seed, a name and a number, so that it depends on nothing else.

Rows come out the same whatever the partitioning, and a lost task draws again what it drew before. Seeds descend from one
another as in records.derive_seed; what is drawn from them is this module's own, no stream of another generator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markerlake.functions.records import derive_seed

TOP = float(1 << 31)


def column(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def seed(parent: Column, name: str, i: Column | int = 0) -> Column:
    return derive_seed(parent, F.lit(name), column(i))


def unit(parent: Column, name: str, i: Column | int = 0) -> Column:
    """At least 0 and below 1."""
    return seed(parent, name, i) / TOP


def uniform(parent: Column, name: str, low: Column | float, high: Column | float, i: Column | int = 0) -> Column:
    low, high = column(low), column(high)
    return low + unit(parent, name, i) * (high - low)


def integer(parent: Column, name: str, low: Column | int, high: Column | int, i: Column | int = 0) -> Column:
    """From low to high, both in."""
    low, high = column(low), column(high)
    return (low + F.floor(unit(parent, name, i) * (high - low + 1))).cast("int")


def choice(parent: Column, name: str, values: Column, i: Column | int = 0) -> Column:
    """One entry of an array; null of an empty one."""
    return F.get(values, F.floor(unit(parent, name, i) * F.size(values)).cast("int"))


def log_uniform(parent: Column, name: str, low: Column | float, high: Column | float, i: Column | int = 0) -> Column:
    return F.exp(uniform(parent, name, F.log(column(low)), F.log(column(high)), i))


def exponential(parent: Column, name: str, i: Column | int = 0) -> Column:
    return -F.log(1 - unit(parent, name, i))


def normal(parent: Column, name: str, i: Column | int = 0) -> Column:
    """Mean 0, deviation 1."""
    return F.sqrt(2 * exponential(parent, f"{name}_r", i)) * F.cos(unit(parent, f"{name}_a", i) * 6.283185307179586)


#: The same draw in SQL.
def unit_sql(parent: str, name: str, i: str = "0") -> str:
    return f"((CAST('0x' || substr(sha256(CAST({parent} AS VARCHAR) || ':{name}:' || CAST({i} AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647) / 2147483648.0)"


def seed_sql(parent: str, name: str, i: str = "0") -> str:
    return f"(CAST('0x' || substr(sha256(CAST({parent} AS VARCHAR) || ':{name}:' || CAST({i} AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647)"
