"""Draws that depend on a seed and on a row's own values, so that reruns, and other engines, agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number from 0 to 1 (excluded): the first 32 bits of the MD5 of seed and keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / (1 << 32)
