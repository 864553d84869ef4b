"""Similarity measures: two rows are compared by their dot product and one number of each row.

A measure says what a value adds to its row's mass, how a mass is finished, and how a dot product and
two finished masses give the similarity. The arithmetic is written once and works on Spark columns and
numpy arrays alike, so the block kernel, the joins and the maintenance share it. ``less`` takes a value
out of a mass again, which is how a forgotten purchase changes a norm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _square(x):
    return x * x


def _same(mass, sqrt):
    return mass


def _root(mass, sqrt):
    return sqrt(mass)


def _over_product(dot, a, b):
    return dot / (a * b)


def _over_union(dot, a, b):
    return dot / (a + b - dot)


@dataclass(frozen=True)
class Measure:
    name: str
    term: Callable          # what a value adds to the mass of its row
    finish: Callable        # (mass, sqrt) -> the number that similarity takes
    similarity: Callable    # (dot, finished a, finished b)

    def less(self, mass, value):
        """The mass without a value."""
        return mass - self.term(value)

    def of_rows(self, values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Finished masses of ``n`` rows, given each value's row."""
        return self.finish(np.bincount(rows, weights=self.term(values), minlength=n), np.sqrt)

    def column(self, dot: str, mass_a: str, mass_b: str) -> Column:
        """Similarity of a dot product and two masses; null where a row has none."""
        a, b = F.col(mass_a), F.col(mass_b)
        return F.when((a > 0) & (b > 0), self.similarity(F.col(dot), self.finish(a, F.sqrt), self.finish(b, F.sqrt)))


# dot / (sqrt(a) * sqrt(b)), in exactly this order in every engine: binary data gives bit-equal values
COSINE = Measure("cosine", _square, _root, _over_product)
# dot / (a + b - dot): for binary rows the Jaccard similarity of their items
TANIMOTO = Measure("tanimoto", _square, _same, _over_union)
