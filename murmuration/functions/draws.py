"""Uniform draws as pure functions of their coordinates.

A draw depends only on (seed, group, particle, component, step), so a retried task, another
partitioning or another cluster size gives the same swarm.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Draw = Callable[[int, Sequence[Column], Column, Column, Column], Column]


def hashed(seed: int, group: Sequence[Column], pid: Column, k: Column, step: Column) -> Column:
    """Uniform in [0, 1) from 53 bits of a 64-bit hash; the generator used for training."""
    word = F.xxhash64(F.lit(seed), *group, pid.cast("long"), k.cast("long"), step.cast("long"))
    return F.shiftrightunsigned(word, 11).cast("double") * F.lit(2.0**-53)


def lattice(seed: int, group: Sequence[Column], pid: Column, k: Column, step: Column) -> Column:
    """Uniform in [0, 1) from one step of a multiplicative congruential generator.

    Plain integer arithmetic that any SQL engine repeats digit for digit.  The points lie on a
    lattice: good for checks, poor for search.  The last group column must be an integer.
    """
    mixed = (
        pid.cast("long") * F.lit(7919)
        + k.cast("long") * F.lit(104729)
        + group[-1].cast("long") * F.lit(15485863)
        + step.cast("long") * F.lit(32452843)
        + F.lit(seed * 1299709)
    )
    return (mixed * F.lit(48271) % F.lit(2147483647)).cast("double") / F.lit(2147483647.0)


def spread(u: Column, limit: float | Column) -> Column:
    """Map [0, 1) to [-limit, limit)."""
    return limit * (F.lit(2.0) * u - F.lit(1.0))


def drawn_vector(draw: Draw, seed: int, group: Sequence[Column], pid: Column, size: int, limit: float,
                 first: int = 0, step: int = 0) -> Column:
    """``size`` draws in [-limit, limit) with component numbers from ``first``."""
    return F.transform(
        F.sequence(F.lit(first), F.lit(first + size - 1)),
        lambda k: spread(draw(seed, group, pid, k, F.lit(step)), F.lit(float(limit))),
    )
