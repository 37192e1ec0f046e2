"""A two-level tree of pivots: cells of a vector space, found with about twice the root of their number of comparisons."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

MATRIX_CELLS = 1 << 22  # distances that one step holds at once


def nearest_of(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Row number of the nearest point of each row of ``x``; memory is bounded whatever the number of points."""
    norms, out = (points**2).sum(1), np.empty(len(x), dtype=np.int64)
    step = max(1, MATRIX_CELLS // max(1, len(points)))
    for a in range(0, len(x), step):
        out[a : a + step] = (norms[None, :] - 2.0 * x[a : a + step] @ points.T).argmin(1)
    return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2.0 * x @ points.T, 0.0))


@dataclass
class CellTree:
    """``leads``, and the ``centres`` of the cells in order of their lead: those of lead g are ``starts[g] : starts[g + 1]``.

    A vector belongs to the lead that is nearest to it, and there to the nearest centre.
    """

    leads: np.ndarray
    centres: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray) -> CellTree:
        """``centres`` must be distinct; about the root of their number lead."""
        leads = centres[np.linspace(0, len(centres) - 1, math.isqrt(len(centres) - 1) + 1).astype(np.int64)]
        own = nearest_of(centres, leads)
        used, own = np.unique(own, return_inverse=True)
        order = np.argsort(own, kind="stable")
        return cls(leads[used], centres[order], np.searchsorted(own[order], np.arange(len(used) + 1)))

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(lead, cell)`` of each row."""
        lead = nearest_of(x, self.leads)
        cell = np.empty(len(x), dtype=np.int64)
        for g in np.unique(lead):
            rows = np.flatnonzero(lead == g)
            cell[rows] = self.starts[g] + nearest_of(x[rows], self.centres[self.starts[g] : self.starts[g + 1]])
        return lead, cell


def border_bounds(d: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each row and point, how near a vector that belongs to the point can come to the row at least: no nearer than the border plane
    between that point and the one nearest to the row. ``d`` has the distances of rows to points."""
    home = d.argmin(1)
    apart = distances(points[home], points)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2.0 * apart)
    return np.where(apart > 0, plane, 0.0)
