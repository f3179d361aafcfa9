"""Expressions over ``array<float>`` columns, and the same for blocks inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnsearch.params import SCORE_DIGITS


def inner_product(left: Column, right: Column) -> Column:
    """Sum of products, in double precision."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; the zero vector stays as it is."""
    norm = l2_norm(vector)
    unit = F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
    return F.when(norm > 0, unit).otherwise(vector.cast("array<float>"))


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    # Adding 0.0 turns a negative zero into a plain one.
    return F.round(score, digits) + F.lit(0.0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1.0)
