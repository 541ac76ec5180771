"""Moments of support that are kept up as units come and go.

Sums can be taken apart again: what a refresh removes is subtracted, what it
adds is added, and only the rows of units that change are read. Rounding grows
with every change, so after REBUILD of them the sums are made anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lodestar.functions.vectors import vector_sums
from lodestar.operators import prototypes

REBUILD = 32


@dataclass(frozen=True)
class Ledger:
    """Weighted n, sum and sum of outer products of rows, and `between`: over
    units, the outer product of the unit's sum with itself by its weight."""

    n: float
    s1: np.ndarray
    s2: np.ndarray
    between: np.ndarray
    changes: int = 0

    @staticmethod
    def of(rows: DataFrame, unit: str = "unit_id", vector: str = "phi", weight: str = "w") -> Ledger | None:
        """Of support rows; None of none."""
        n, s1, s2 = prototypes.moments(rows, vector, weight)
        if not n:
            return None
        between = np.zeros_like(s2)
        for r in vector_sums(rows, [unit], vector, weight).toLocalIterator():  # one sum for each unit, as they come
            s = np.array(r["s1"])
            between += np.outer(s, s) / r["n"]
        return Ledger(n, s1, s2, between)

    def changed(self, removed: Ledger | None, added: Ledger | None) -> Ledger:
        n, s1, s2, between = self.n, self.s1, self.s2, self.between
        for part, sign in ((removed, -1.0), (added, 1.0)):
            if part is not None:
                n, s1, s2, between = n + sign * part.n, s1 + sign * part.s1, s2 + sign * part.s2, between + sign * part.between
        return Ledger(n, s1, s2, between, self.changes + 1)

    def scatters(self) -> tuple[np.ndarray, np.ndarray]:
        """Total and within scatter, made symmetric."""
        total, within = self.s2 - np.outer(self.s1, self.s1) / self.n, self.s2 - self.between
        return (total + total.T) / 2, (within + within.T) / 2
