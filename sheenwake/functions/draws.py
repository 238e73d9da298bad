"""Deterministic draws: the same keys give the same number on every partitioning.

The mixer is plain modular arithmetic, so the JVM, NumPy and SQL all agree.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2_147_483_647
_A, _B, _C, _D = 7919, 104729, 1299709, 15485863


def mix(slick, particle, step, stream):
    """A number in [0, P). Works on Columns and on NumPy int64 arrays alike."""
    h = ((slick % 1_000_003) * _A + (particle % 1_000_003) * _B + step * _C + stream * _D) % P
    g = (h * h + 12345) % P
    h = (g * 48271 + h) % P
    return (h * h + 6789) % P


def uniform(slick: Column, particle: Column, step, stream: int) -> Column:
    """A double in (0, 1)."""
    s = F.lit(step) if isinstance(step, int) else step
    h = mix(slick.cast("long"), particle.cast("long"), s.cast("long"), F.lit(stream).cast("long"))
    return (h.cast("double") + 0.5) / float(P)


def normal_pair(slick: Column, particle: Column, step, stream: int) -> tuple[Column, Column]:
    """Two independent standard normals (Box-Muller)."""
    u1 = uniform(slick, particle, step, stream)
    u2 = uniform(slick, particle, step, stream + 1)
    r, a = F.sqrt(-2.0 * F.log(u1)), F.lit(2 * math.pi) * u2
    return r * F.cos(a), r * F.sin(a)


def np_uniform(slick, particle, step: int, stream: int):
    return (mix(slick.astype(np.int64), particle.astype(np.int64), np.int64(step),
                np.int64(stream)).astype(float) + 0.5) / float(P)


def np_normal_pair(slick, particle, step: int, stream: int):
    u1, u2 = np_uniform(slick, particle, step, stream), np_uniform(slick, particle, step, stream + 1)
    r, a = np.sqrt(-2.0 * np.log(u1)), 2 * math.pi * u2
    return r * np.cos(a), r * np.sin(a)
