"""Partition-independent pseudo-randomness: every draw is a function of (seed, key, position)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

MODULUS = 2147483647            # 2**31 - 1; products of two residues stay below 2**62


def hash32(c: Column) -> Column:
    """First 32 bits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def seeded(seed: int, *keys: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])


def unit(c: Column) -> Column:
    """md5 prefix as a fraction in [0, 1)."""
    return hash32(c) / F.lit(4294967296.0)


def draw(start: Column, position: Column, salt: int = 0) -> Column:
    """Cheap integer draw in [0, MODULUS) for a position inside a row whose ``start`` is a hash.

    A squared Weyl sequence: two multiplications per call, so it can run once per character.
    """
    x = (start + position.cast("bigint") * F.lit(748321 + 2 * salt)) % F.lit(MODULUS)
    return (x * x + F.lit(salt)) % F.lit(MODULUS)


def draws(start: np.ndarray, position: np.ndarray, salt: int = 0) -> np.ndarray:
    """``draw`` of many positions in numpy."""
    x = (start + position * (748321 + 2 * salt)) % MODULUS
    return (x * x + salt) % MODULUS


def draw_unit(start: Column, position: Column, salt: int = 0) -> Column:
    return draw(start, position, salt) / F.lit(float(MODULUS))
