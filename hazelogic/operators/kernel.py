"""Firing strengths of large models in NumPy over Arrow batches.

A model of hundreds of memberships makes a projection of hundreds of
exponentials a row, which generated code splits and the JVM computes one by
one. Here a batch is scored a feature at a time for all labels and parts
together; rows stay in their partitions and nothing is shuffled. Small models
are better off as Columns (`infer.firing`), which need no Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.functions import membership, norms
from hazelogic.operators import infer
from hazelogic.operators.infer import Model

#: Rows scored at a time: a block's memberships stay in the cache.
BLOCK = 1024


def _fold_or(g: np.ndarray, family: str) -> np.ndarray:
    """OR over the last axis."""
    if g.shape[-1] == 1:
        return g[..., 0]
    if family == "min_max":
        return g.max(axis=-1)
    if family == "probability":
        return 1 - (1 - g).prod(axis=-1)
    if family == "luk":
        return np.minimum(1.0, g.sum(axis=-1))
    if family == "hamacher":
        odds = (g / np.where(g < 1, 1 - g, 1)).sum(axis=-1)
        return np.where(g.max(axis=-1) >= 1, 1.0, odds / (1 + odds))
    up, down = (1 + g).prod(axis=-1), (1 - g).prod(axis=-1)
    return (up - down) / (up + down)


class Kernel:
    """A model's parameters by feature as arrays over labels and parts."""

    def __init__(self, model: Model, t_norm: str = "probability", t_conorm: str | None = None):
        self.model = model
        self.t_norm, self.t_conorm = norms.resolve(t_norm, t_norm, t_conorm or t_norm, allow_mixed=True)
        cells, labels = model.shapes(), model.labels
        parts = max(len(v) for v in cells.values())
        if any(p.kind != "gaussian" for v in cells.values() for p in v):
            raise ValueError("the kernel takes Gaussian memberships")
        self.mu, self.scale = np.zeros((len(model.features), len(labels), parts)), np.zeros((len(model.features), len(labels), parts))
        self.gone = np.ones((len(model.features), len(labels), parts), bool)
        for (f, x), v in cells.items():
            for k, p in enumerate(v):
                at = model.features.index(f), labels.index(x), k
                self.mu[at], self.scale[at], self.gone[at] = p.params[0], np.sqrt(0.5) / max(p.params[1], membership.SIGMA_FLOOR), False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows x labels strengths of rows x features in the model's order."""
        out = np.empty((len(x), len(self.model.labels)))
        for lo in range(0, len(x), BLOCK):
            out[lo : lo + BLOCK] = self._block(x[lo : lo + BLOCK])
        return out

    def _block(self, x: np.ndarray) -> np.ndarray:
        shape, n = self.mu.shape[1:], self.mu.shape[0]
        total, more = None, None
        for f in range(n):
            z = x[:, f, None] - self.mu[f].ravel()
            z *= self.scale[f].ravel()
            np.multiply(z, z, out=z)
            np.negative(z, out=z)
            g = np.exp(z, out=z).reshape(len(x), *shape)
            if self.gone[f].any():
                g[:, self.gone[f]] = 0.0
            c = _fold_or(g, self.t_conorm)
            if self.t_norm == "min_max":
                total = c if total is None else np.minimum(total, c)
            elif self.t_norm == "luk":
                total = c if total is None else total + c
            elif self.t_norm == "hamacher":
                odds = (1 - c) / np.where(c > 0, c, 1)
                total, more = (odds, c) if total is None else (total + odds, np.minimum(more, c))
            else:
                if self.t_norm == "einstein":
                    more = 2 - c if more is None else more * (2 - c)
                total = c if total is None else total * c
        if self.t_norm == "luk":
            return np.maximum(0.0, total - (n - 1))
        if self.t_norm == "hamacher":
            return np.where(more <= 0, 0.0, 1 / (1 + total))
        if self.t_norm == "einstein":
            return 2 * total / (more + total)
        return total


def score(df: DataFrame, model: Model, keep: list[str], what: str = "strengths", t_norm: str = "probability", t_conorm: str | None = None) -> DataFrame:
    """The columns `keep` with strengths, probabilities (arrays in label order) or label.

    Null and NaN features make a row's result null. An empty table gives an
    empty result.
    """
    kind = {"strengths": "array<double>", "probabilities": "array<double>", "label": "string"}[what]
    given = df.sparkSession.sparkContext.broadcast(Kernel(model, t_norm, t_conorm))  # of infer.MAX_MODEL memberships at most
    features, labels = model.features, np.array(model.labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1) if b.num_rows else np.zeros((0, len(features)))
            bad = np.isnan(x).any(axis=1)
            s = given.value(np.where(np.isnan(x), 0.0, x))
            if what == "label":
                out = pa.array(labels[s.argmax(axis=1)].tolist() if len(s) else [], pa.string(), mask=bad)
            else:
                if what == "probabilities":
                    t = s.sum(axis=1, keepdims=True)
                    s = np.where(t == 0, 1 / s.shape[1], s / np.where(t == 0, 1, t))
                out = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))
                if bad.any():
                    out = pa.array([None if k else v for k, v in zip(bad, out.to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], out], names=[*keep, what])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).mapInArrow(run, f"{schema + ', ' if keep else ''}{what} {kind}")


#: Memberships beyond which the kernel is the faster way.
LARGE = 64


def strengths(df: DataFrame, model: Model, keep: list[str], t_norm: str = "probability") -> DataFrame:
    """`keep` and strengths by the faster way for the model's size; both give the same numbers."""
    if sum(map(len, model.cells.values())) > LARGE and all(p.kind == "gaussian" for v in model.shapes().values() for p in v):
        return score(df, model, keep, "strengths", t_norm)
    return df.select(*keep, infer.firing(model, t_norm).alias("strengths"))
