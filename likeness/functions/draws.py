"""Draws that are pure functions of (seed, column, id).

A retried task, another partitioning or another cluster size gives the same
values, which ``rand()`` cannot promise.  Everything stays a JVM expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed, name: str, id_col) -> Column:
    """32 hex digits of ``md5('seed|name|id')``."""
    return F.md5(F.concat(F.lit(f"{seed}|{name}|"), as_col(id_col).cast("string")))


def uniform(seed, name: str, id_col) -> Column:
    """A draw strictly inside (0, 1) from the first 52 bits of the hash."""
    bits = F.conv(F.substring(hash_hex(seed, name, id_col), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def gaussian(seed, name: str, id_col) -> Column:
    """A standard normal draw (Box-Muller on two independent uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, f"{name}#r", id_col)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, f"{name}#a", id_col))
