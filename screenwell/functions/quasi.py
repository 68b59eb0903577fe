"""Low-discrepancy numbers (van der Corput 1935, Halton 1960)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from .columns import col

# One base per dimension.
PRIMES = (2, 3, 5, 7, 11, 13, 17)


def radical_inverse(index, base: int, largest: int = (1 << 63) - 1) -> Column:
    """Digits of `index` in `base`, mirrored at the point; digits by integer division. `largest` bounds the index."""
    i, power, terms = col(index).cast("long"), 1, []
    while power <= largest:
        digit = F.call_function("div", i, F.lit(power).cast("long")) % base
        terms.append(digit / F.lit(float(power * base)))
        power *= base
    return functools.reduce(lambda a, b: a + b, terms)


def halton(index, dim: int = 0, largest: int = (1 << 63) - 1) -> Column:
    """The draw for a 0-based index in one dimension."""
    return radical_inverse(col(index) + 1, PRIMES[dim], largest)
