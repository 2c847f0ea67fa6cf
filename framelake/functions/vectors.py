"""Array columns: element-wise arithmetic and reproducible draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def array_mode(values: Column) -> Column:
    """Most frequent element, the smallest one on a tie."""
    ranked = F.transform(
        F.array_distinct(values),
        lambda v: F.struct(
            (-F.size(F.filter(values, lambda x: x == v))).alias("neg_n"), v.alias("v")
        ),
    )
    return F.array_min(ranked)["v"]


def max_abs_diff(left: Column, right: Column) -> Column:
    return F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def uniform(seed: int, *keys: Column) -> Column:
    """A draw from (0, 1) fixed by the seed and the keys, whatever the partitioning or the engine.

    The first 13 hex digits of a SHA-256 are 52 bits, which a double holds exactly.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw (Box-Muller) fixed by the seed and the keys."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, F.lit("radius"), *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, F.lit("angle"), *keys))


def normal_vector(seed: int, dim: int, *keys: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: normal(seed, *keys, d)
    )
