"""Random numbers that are a pure function of keys, so results don't depend on how data is partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants of the linear congruential step.
A, C, M = 1103515245, 12345, 2147483648


def _step(x: Column, k: Column, seed: int) -> Column:
    return F.pmod(F.pmod(x, F.lit(M)) * F.lit(A) + k * F.lit(C) + F.lit(seed), F.lit(M))


def keyed_uniform(key: Column, k: Column | int, seed: int = 0) -> Column:
    """In (0, 1), never 0 or 1: two rounds, since one is visibly correlated for consecutive keys."""
    k = F.lit(k).cast("long") if isinstance(k, int) else k.cast("long")
    s = _step(_step(key.cast("long"), k, seed), k, seed)
    return (s.cast("double") + F.lit(0.5)) / F.lit(float(M))


def keyed_normal(key: Column, k: Column | int, seed: int = 0) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u, v = keyed_uniform(key, k, seed), keyed_uniform(key, k, seed + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def uniform_sql(key: str, k: str, seed: int = 0) -> str:
    """The same number in SQL."""
    one = f"((({key}) % {M}) * {A}::bigint + ({k}) * {C} + {seed}) % {M}"
    two = f"(({one}) * {A}::bigint + ({k}) * {C} + {seed}) % {M}"
    return f"((({two})::double + 0.5::double) / {M}::double)"


def normal_sql(key: str, k: str, seed: int = 0) -> str:
    return f"(sqrt(-2.0::double * ln({uniform_sql(key, k, seed)})) * cos({2.0 * math.pi!r}::double * {uniform_sql(key, k, seed + 1)}))"
