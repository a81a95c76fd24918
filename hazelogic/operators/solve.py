"""Consequent solves: corrections by bucket, RBF centres, choice by folds, and grids of rules."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.operators import fit
from hazelogic.operators.infer import basis
from hazelogic.operators.interactions import moments
from hazelogic.operators.partial import PLACES, at_places, sum_places


def bucket_corrections(df: DataFrame, features: list[str], target: str, bucket: str, order: int = 1, l2: float = 0.0) -> dict[int, np.ndarray]:
    """For each bucket the least-squares coefficients of [1, powers of the features]."""
    terms = [t for f in features for t in basis(F.col(f).cast("double"), order)]
    grams = moments(df, terms, F.col(target), F.col(bucket))
    return {k: solve_gram(g, l2) for k, g in sorted(grams.items())}


def solve_gram(g: np.ndarray, l2: float = 0.0) -> np.ndarray:
    """Ridge coefficients from the Gram matrix of [1, terms, target]; the intercept is free."""
    n = len(g) - 1
    scale = np.sqrt(np.maximum(np.diag(g)[:n], 1e-300))
    a = g[:n, :n] / np.outer(scale, scale) + np.diag(np.append(0.0, np.full(n - 1, l2)) / scale**2)
    return np.linalg.lstsq(a, g[:n, n] / scale, rcond=None)[0] / scale


def rbf_centres(df: DataFrame, features: list[str], n: int = 5) -> list[list[float]]:
    """A star: the medians, then one feature at a time at quantiles from .1 to .9."""
    shares = [0.5, *[0.1 + 0.8 * k / (n - 1) for k in range(n)]] if n > 1 else [0.5]
    got = [fit.quantiles(df, f, shares) or None for f in features]
    mid = [q[0] if q else 0.0 for q in got]
    out = [mid]
    for i, q in enumerate(got):
        out += [[*mid[:i], v, *mid[i + 1 :]] for v in (q or [])[1:] if v != mid[i]]
    return out


def rbf_terms(features: list[str], centres: list[list[float]], radius: float, cut: float | None = None) -> list[Column]:
    """Gaussian of the distance to each centre; 0 beyond `cut` radii where it is given."""
    out = []
    for c in centres:
        d = sum((F.pow(F.col(f) - v, 2.0) for f, v in zip(features[1:], c[1:], strict=True)), F.pow(F.col(features[0]) - c[0], 2.0)) / radius**2
        g = F.exp(-0.5 * d)
        out.append(F.when(d <= cut * cut, g).otherwise(0.0) if cut else g)
    return out


def choose_by_folds(df: DataFrame, features: list[str], target: str, orders: tuple[int, ...] = (1, 2, 3), kinds: tuple[str, ...] = ("raw", "legendre"), penalties: tuple[float, ...] = (1e-6, 1e-3, 1e-1), folds: int = 5) -> DataFrame:
    """`basis, order, l2, r2`: mean held-out R² of each choice, best first.

    Folds go by a hash of the values; a pass for each basis and order gathers
    the Gram matrix of every fold, from which all penalties are solved.
    """
    out = []
    fold = F.pmod(F.xxhash64(*features, target), F.lit(folds))
    for kind, order in itertools.product(kinds, orders):
        grams = moments(df, [t for f in features for t in basis(F.col(f).cast("double"), order, kind)], F.col(target), fold)
        if len(grams) < 2:
            continue
        total = sum(grams.values())
        for l2 in penalties:
            scores = []
            for g in grams.values():
                e = np.append(-solve_gram(total - g, l2), 1.0)
                spread = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
                scores.append(1 - float(e @ g @ e) / spread if spread > 0 else 0.0)
            out.append((kind, order, l2, float(np.mean(scores))))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: -r[3]), "basis string, order int, l2 double, r2 double")


# ------------------------------------------------------------ adaptive grids of rules


class Anfis:
    """A grid of rules over `n_terms` Gaussians a feature, with linear consequents.

    An epoch is two passes: partial Gram matrices give the consequents, then
    partial gradients of the squared error move the premises by Adam. Rules
    are n_terms ** features; more than `MOST_RULES` are refused.
    """

    MOST_RULES = 256

    def __init__(self, features: list[str], target: str, n_terms: int = 2, epochs: int = 20, rate: float = 0.05, l2: float = 1e-6):
        if n_terms ** len(features) > self.MOST_RULES:
            raise ValueError(f"{n_terms ** len(features)} rules exceed {self.MOST_RULES}")
        self.features, self.target, self.n_terms, self.epochs, self.rate, self.l2 = features, target, n_terms, epochs, rate, l2
        self.grid = np.array(list(itertools.product(range(n_terms), repeat=len(features))))

    def _norm(self, x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
        logs = -0.5 * ((x[:, :, None] - mu) / sd) ** 2
        w = sum(logs[:, f, self.grid[:, f]] for f in range(len(self.features)))
        w = np.exp(w - w.max(axis=1, keepdims=True))
        return w / w.sum(axis=1, keepdims=True)

    def _pass(self, rows: DataFrame, stats, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    z = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                    total += stats(z[:, :-1], z[:, -1])
            yield at_places(total)

        return sum_places(rows.mapInArrow(run, PLACES), size)

    def fit(self, df: DataFrame) -> Anfis:
        rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*self.features, self.target])])
        rows = rows.where(~F.exists(F.array(*rows.columns), lambda v: v.isNull() | F.isnan(v)))
        nf, k = len(self.features), self.n_terms
        ends = rows.agg(*[g(f"c{i}") for i in range(nf) for g in (F.min, F.max)]).first()
        lo, hi = (np.array([ends[2 * i + j] if ends[2 * i + j] is not None else float(j) for i in range(nf)]) for j in (0, 1))
        span = np.where(hi > lo, hi - lo, 1.0)
        mu = lo[:, None] + span[:, None] * (np.arange(k) + 0.5) / k
        sd = np.repeat(span[:, None] / k, k, axis=1)
        p, m1, m2, best = (nf + 1) * len(self.grid), 0.0, 0.0, None
        for epoch in range(self.epochs + 1):

            def gram(x, y, mu=mu, sd=sd):
                w = self._norm(x, mu, sd)
                z = np.column_stack([np.ones(len(x)), (x - lo) / span])
                a = np.column_stack([(w[:, :, None] * z[:, None, :]).reshape(len(x), p), y])
                return (a.T @ a).ravel()

            g = self._pass(rows, gram, (p + 1) ** 2).reshape(p + 1, p + 1)
            penalty = np.full(p, self.l2)
            penalty[:: nf + 1] = 1e-12
            beta = np.linalg.lstsq(g[:p, :p] + np.diag(penalty), g[:p, p], rcond=None)[0]
            e = np.append(-beta, 1.0)
            error = float(e @ g @ e)
            if best is None or error < best[0]:
                best = (error, mu.copy(), sd.copy(), beta.reshape(len(self.grid), nf + 1))
            if epoch == self.epochs:
                break

            def slope(x, y, mu=mu, sd=sd, b=beta.reshape(len(self.grid), nf + 1)):
                w = self._norm(x, mu, sd)
                v = np.column_stack([np.ones(len(x)), (x - lo) / span]) @ b.T
                out = (w * v).sum(axis=1)
                d = 2 * (out - y)[:, None] * w * (v - out[:, None])
                gm, gs = np.zeros((nf, k)), np.zeros((nf, k))
                for f in range(nf):
                    for t in range(k):
                        dt = d[:, self.grid[:, f] == t].sum(axis=1)
                        u = (x[:, f] - mu[f, t]) / sd[f, t]
                        gm[f, t], gs[f, t] = (dt * u).sum() / sd[f, t] * span[f], (dt * u * u).sum() / sd[f, t] * span[f]
                return np.concatenate([gm.ravel(), gs.ravel(), [len(x)]])

            s = self._pass(rows, slope, 2 * nf * k + 1)
            grad = s[:-1] / max(s[-1], 1)
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            move = self.rate * (m1 / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            mu = mu - move[: nf * k].reshape(nf, k) * span[:, None]
            sd = np.maximum(sd - move[nf * k :].reshape(nf, k) * span[:, None], 0.02 * span[:, None])
        self.error, self.mu, self.sd, self.beta = best
        self.lo, self.span = lo, span
        return self

    def predict(self) -> Column:
        """The prediction as an expression over the features."""
        x = [F.col(f).cast("double") for f in self.features]
        logs = [[-0.5 * F.pow((x[f] - float(self.mu[f, t])) / float(self.sd[f, t]), 2.0) for t in range(self.n_terms)] for f in range(len(x))]
        rule = F.array(*[sum((logs[f][t] for f, t in enumerate(g) if f), logs[0][g[0]]) for g in self.grid.tolist()])
        w = F.transform(rule, lambda v: F.exp(v - F.array_max(rule)))
        z = [(x[f] - float(self.lo[f])) / float(self.span[f]) for f in range(len(x))]
        vals = F.array(*[sum((z[f] * float(b[f + 1]) for f in range(len(z))), F.lit(float(b[0]))) for b in self.beta])
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
        return add(F.zip_with(w, vals, lambda a, b: a * b)) / add(w)

    def describe_rules(self) -> list[str]:
        out = []
        for g, b in zip(self.grid.tolist(), self.beta, strict=True):
            head = " AND ".join(f"{f} is N({self.mu[i, t]:.3g}, {self.sd[i, t]:.3g})" for i, (f, t) in enumerate(zip(self.features, g, strict=True)))
            out.append(f"IF {head} THEN {b[0]:.4g}" + "".join(f" {w:+.4g}*{f}" for w, f in zip(b[1:], self.features, strict=True)))
        return out
