"""Bayesian Hilbert maps: occupancy as logistic regression on radial features, learnt by expectation-maximisation.

One map is one group: its points and its state (a mean and precision of M + 1 weights) are handled by an Arrow kernel, so many maps
train in parallel. Predictions broadcast a map's state, of fixed size, to all query points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class HilbertMap:
    """hinges (M, dim), width of the kernel, mean (M + 1), precision (M + 1: diagonal, or M + 1 square), information (M + 1)."""

    hinges: np.ndarray
    width: float
    mean: np.ndarray
    precision: np.ndarray
    information: np.ndarray

    @classmethod
    def blank(cls, hinges: np.ndarray, width: float, diagonal: bool = True, prior: float = 1e-4) -> HilbertMap:
        n = len(hinges) + 1
        return cls(np.asarray(hinges, float), width, np.zeros(n), np.full(n, prior) if diagonal else np.eye(n) * prior, np.zeros(n))

    def features(self, x: np.ndarray) -> np.ndarray:
        gap = ((x[:, None, :] - self.hinges[None]) ** 2).sum(2)
        return np.concatenate([np.ones((len(x), 1)), np.exp(-gap / (2 * self.width**2))], 1)

    def variance(self, phi: np.ndarray) -> np.ndarray:
        if self.precision.ndim == 1:
            return (phi**2 / self.precision).sum(1)
        half = np.linalg.solve(np.linalg.cholesky(self.precision), phi.T)
        return (half**2).sum(0)

    def update(self, x: np.ndarray, y: np.ndarray, rounds: int = 3) -> None:
        """Labels 0 or 1. Precision and information add up over rounds and scans, given the bound's parameters."""
        phi, xi = self.features(x), np.ones(len(x))
        for _ in range(rounds):
            bound = np.where(xi < 1e-6, 0.25, (1 / (1 + np.exp(-xi)) - 0.5) / np.maximum(xi, 1e-12))
            if self.precision.ndim == 1:
                self.precision = self.precision + (bound[:, None] * phi**2).sum(0)
            else:
                self.precision = self.precision + phi.T @ (bound[:, None] * phi)
            self.information = self.information + phi.T @ (y - 0.5)
            self.mean = self.information / self.precision if self.precision.ndim == 1 else np.linalg.solve(self.precision, self.information)
            xi = np.sqrt(self.variance(phi) + (phi @ self.mean) ** 2)

    def odds(self, x: np.ndarray, fast: bool = False) -> np.ndarray:
        phi = self.features(x)
        h = phi @ self.mean
        return h if fast else h / np.sqrt(1 + np.pi / 8 * self.variance(phi))

    def predict(self, x: np.ndarray, fast: bool = False) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x, fast)))

    def gradient(self, x: np.ndarray, probability: bool = True) -> np.ndarray:
        """Gradient of the probability (or of its log-odds) at each point."""
        phi = self.features(x)
        move = np.concatenate([np.zeros((len(x), 1, x.shape[1])), phi[:, 1:, None] * (self.hinges[None] - x[:, None, :]) / self.width**2], 1)
        inverse = phi / self.precision if self.precision.ndim == 1 else np.linalg.solve(self.precision, phi.T).T
        f, v = phi @ self.mean, (phi * inverse).sum(1)
        c = 1 + np.pi / 8 * v
        df = np.einsum("nmd,m->nd", move, self.mean)
        dv = 2 * np.einsum("nmd,nm->nd", move, inverse)
        out = df / np.sqrt(c)[:, None] - (0.5 * np.pi / 8 * f / c**1.5)[:, None] * dv
        if probability:
            p = 1 / (1 + np.exp(-f / np.sqrt(c)))
            out = out * (p * (1 - p))[:, None]
        return out




def train_maps(samples: DataFrame, map_id: str, hinges: np.ndarray, width: float, scan: str | None = None, rounds: int = 3, diagonal: bool = True) -> DataFrame:
    """map_id, mean, precision, information (arrays) after all samples (x, y[, z], label), scan by scan."""
    axes = [a for a in ("x", "y", "z") if a in samples.columns]

    def run(table: pa.Table) -> pa.Table:
        m = HilbertMap.blank(hinges, width, diagonal)
        x = np.stack([table.column(a).to_numpy() for a in axes], 1)
        y = table.column("label").to_numpy().astype(float)
        s = table.column(scan).to_numpy() if scan else np.zeros(len(y))
        for k in np.unique(s):
            m.update(x[s == k], y[s == k], rounds)
        return pa.table({map_id: pa.array([table.column(map_id)[0].as_py()], pa.int64()), **{n: pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for n, v in (("mean", m.mean), ("precision", m.precision), ("information", m.information))}})

    rows = samples.select(*[samples[map_id].cast("long").alias(map_id)], *([scan] if scan else []), *axes, "label")
    return rows.groupBy(map_id).applyInArrow(run, f"{map_id} long, mean array<double>, precision array<double>, information array<double>")


def load_map(row: object, hinges: np.ndarray, width: float) -> HilbertMap:
    n = len(hinges) + 1
    precision = np.array(row["precision"])
    return HilbertMap(np.asarray(hinges, float), width, np.array(row["mean"]), precision if len(precision) == n else precision.reshape(n, n), np.array(row["information"]))


def predict(points: DataFrame, point_id: str, m: HilbertMap, fast: bool = False, gradient: bool = False, block: int = 2000) -> DataFrame:
    """point_id, probability[, gx, gy[, gz]] of points (x, y[, z])."""
    axes = [a for a in ("x", "y", "z") if a in points.columns][: m.hinges.shape[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                x = np.stack([part.column(a).to_numpy() for a in axes], 1)
                out = [part.column(0), pa.array(m.predict(x, fast))]
                if gradient:
                    g = m.gradient(x)
                    out += [pa.array(g[:, i].copy()) for i in range(len(axes))]
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["point", "probability", *([f"g{a}" for a in axes] if gradient else [])]
    kind = ", ".join(["point long", *[f"{n} double" for n in names[1:]]])
    return points.select(points[point_id].cast("long").alias("point"), *axes).mapInArrow(run, kind)
