"""Order-preserving bins, for exact ranks without sorting a whole group."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BINS_PER_E_FOLD = 1024
_OFFSET = 1 << 20
LOWEST_BIN, HIGHEST_BIN = -2 * _OFFSET, 2 * _OFFSET


def order_bin(value: Column) -> Column:
    """Integer that never decreases as ``value`` grows.

    Logarithmic bins: all 32-bit floats fall into fewer than 400 000 bins, each
    with fewer than 20 000 different floats, so neither the bins of a group nor
    the values of a bin can grow with the data.
    """
    x = value.cast("double")
    # Infinities and NaN, which Spark orders last, have bins of their own.
    finite = F.when(F.abs(x) < float("inf"), x)
    size = F.floor(F.ln(F.abs(finite)) * BINS_PER_E_FOLD) + _OFFSET
    # Never NULL, so that joins on the bin add no filters and shuffles can be reused.
    bin_of = (
        F.when(F.isnan(x), HIGHEST_BIN)
        .when(x == float("inf"), HIGHEST_BIN - 1)
        .when(x == float("-inf"), LOWEST_BIN)
        .when(x > 0, size)
        .when(x < 0, -size)
        .otherwise(F.lit(0))
    )
    return F.coalesce(bin_of.cast("int"), F.lit(0))
