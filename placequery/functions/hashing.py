"""Repeatable arithmetic hash used wherever a random draw is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knuth's multiplicative constant and the 32-bit modulus.
MULTIPLIER = 2654435761
MODULUS = 4294967296


def draw(key: Column, seed: int = 0) -> Column:
    """Pseudo-random BIGINT in [0, 2^32) that SQL engines can repeat."""
    reduced = F.pmod(key.cast("bigint"), F.lit(MODULUS))
    high, low = F.shiftright(reduced, 16), reduced.bitwiseAND(F.lit(65535))
    # Two 16-bit halves keep every product inside a signed 64-bit integer.
    product = F.pmod(high * F.lit(MULTIPLIER), F.lit(65536)) * F.lit(65536) + low * F.lit(MULTIPLIER)
    return F.pmod(product + F.lit(seed), F.lit(MODULUS))
