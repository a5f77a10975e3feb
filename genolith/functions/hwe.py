"""Exact test of Hardy-Weinberg equilibrium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_factorials(most: int) -> np.ndarray:
    """Logarithms of 0! to ``most``!."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])


def exact_p(hom_ref: int, het: int, hom_alt: int, logs: np.ndarray | None = None) -> float:
    """Probability of heterozygote counts no likelier than ``het``, given the allele counts; 1 without samples. ``logs``: log factorials, of the number of samples at least."""
    n, rare = hom_ref + het + hom_alt, 2 * min(hom_ref, hom_alt) + het
    if n == 0:
        return 1.0
    logs = log_factorials(n) if logs is None else logs
    h = np.arange(rare % 2, rare + 1, 2)
    weight = h * np.log(2) - logs[h] - logs[(rare - h) // 2] - logs[n - (rare + h) // 2]
    p = np.exp(weight - weight.max())
    return float(min(1.0, p[p <= p[het // 2] * (1 + 1e-9)].sum() / p.sum()))


@F.pandas_udf(DoubleType())
def hwe_p(hom_ref: pd.Series, het: pd.Series, hom_alt: pd.Series) -> pd.Series:
    counts, place = np.unique(np.stack([hom_ref, het, hom_alt], axis=1).astype(np.int64), axis=0, return_inverse=True)  # most sites share theirs with others
    logs = log_factorials(int(counts.sum(axis=1).max(initial=0)))
    return pd.Series(np.array([exact_p(*map(int, c), logs) for c in counts], float)[place.ravel()])
