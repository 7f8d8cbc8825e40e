"""Vector columns and the per-task scoring kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """``1 - cosine distance`` in double precision."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = np.nan
    return matrix / norms


def best_rows(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best scores; equal scores go to the smaller id."""
    if len(scores) > keep:
        cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], -scores[near]))
    return near[order[:keep]]
