"""Iterative training: each step scores many candidates in one pass over the rows.

A loss is a NumPy function of a batch and a candidate vector. Tasks send back
one number for each candidate, so a search costs passes, not data on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.functions import membership
from hazelogic.operators.infer import ZERO_FIRING, Model
from hazelogic.operators.partial import at_places, sum_places

LEAST_PROBABILITY = 1e-12
LEAST_DECREASE = 1e-12
LEAST_SIGMA_SHARE = 0.02

Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def mean_loss(df: DataFrame, features: list[str], target: str, loss: Loss, candidates: np.ndarray) -> np.ndarray:
    """The mean of a row loss for every candidate, in one pass; rows with a null or NaN are left out.

    An empty table gives zeros.
    """
    cols = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    rows = rows.where(~F.exists(F.array(*rows.columns), lambda v: v.isNull() | F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(candidates)), 0
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                n += len(x)
                total += [float(loss(x[:, :-1], x[:, -1], c).sum()) for c in candidates]
        yield at_places(np.append(total, n))

    sums = sum_places(rows.mapInArrow(run, "i long, v double"), len(candidates) + 1)
    return sums[:-1] / max(sums[-1], 1)


# ------------------------------------------------------------ models as vectors


def to_vector(model: Model) -> np.ndarray:
    """(mu, sigma) of every membership, by feature, label and place."""
    return np.array([v for k in sorted(model.cells) for m in model.cells[k] for v in m])


def from_vector(model: Model, v: np.ndarray) -> Model:
    it = iter(float(x) for x in v)
    return Model({k: [(next(it), next(it)) for _ in model.cells[k]] for k in sorted(model.cells)})


def bounds(df: DataFrame, model: Model) -> np.ndarray:
    """Low and high ends: means inside the observed range, deviations from 0.02 to 1 of it."""
    ends = df.agg(*[g(F.col(f).cast("double")) for f in model.features for g in (F.min, F.max)]).first()
    box = {f: (ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0) for i, f in enumerate(model.features)}
    out = []
    for k in sorted(model.cells):
        lo, hi = box[k[0]]
        span = (hi - lo) or 1.0
        out += [(lo, hi), (LEAST_SIGMA_SHARE * span, span)] * len(model.cells[k])
    return np.array(out)


def firing_np(model: Model, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows x labels strengths of the probability family; columns of `x` in feature order."""
    out, at = np.ones((len(x), len(model.labels))), 0
    for f, label in sorted(model.cells):
        miss = np.ones(len(x))
        for _ in model.cells[f, label]:
            miss *= 1 - np.exp(-0.5 * ((x[:, model.features.index(f)] - v[at]) / max(v[at + 1], 1e-6)) ** 2)
            at += 2
        out[:, model.labels.index(label)] *= 1 - miss
    return out


class IncrementalFiring:
    """`firing_np` for many candidates over one batch: only cells that a candidate moves are worked out anew.

    The memberships of a base vector are kept by cell; a candidate pays for its
    changed cells and one product over features for each label they touch.
    """

    def __init__(self, model: Model):
        self.model, self.x, self.base = model, None, None
        at, self.places = 0, {}
        for k in sorted(model.cells):
            self.places[k] = (at, at + 2 * len(model.cells[k]))
            at = self.places[k][1]

    def _cell(self, k: tuple[str, str], v: np.ndarray) -> np.ndarray:
        lo, hi = self.places[k]
        x, miss = self.x[:, self.model.features.index(k[0])], 1.0
        for i in range(lo, hi, 2):
            miss = miss * (1 - np.exp(-0.5 * ((x - v[i]) / max(v[i + 1], 1e-6)) ** 2))
        return 1 - miss

    def __call__(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        if x is not self.x or self.base is None:
            self.x, self.base = x, v.copy()
            self.cells = {k: self._cell(k, v) for k in self.places}
            self.total = np.ones((len(x), len(self.model.labels)))
            for (_, label), c in self.cells.items():
                self.total[:, self.model.labels.index(label)] *= c
            return self.total
        moved = [k for k, (lo, hi) in self.places.items() if not np.array_equal(v[lo:hi], self.base[lo:hi])]
        if not moved:
            return self.total
        new, out = {k: self._cell(k, v) for k in moved}, self.total.copy()
        for label in {label for _, label in moved}:
            j = self.model.labels.index(label)
            out[:, j] = 1.0
            for k, c in self.cells.items():
                if k[1] == label:
                    out[:, j] *= new.get(k, c)
        return out


def cross_entropy(model: Model, start: np.ndarray, box: np.ndarray, l2: float = 0.05) -> Loss:
    """-log of the true label's probability (target: label number), with pull towards the start in box widths."""
    width, fire = np.maximum(box[:, 1] - box[:, 0], 1e-12), IncrementalFiring(model)

    def loss(x, y, v):
        s = fire(x, v)
        total = s.sum(axis=1, keepdims=True)
        p = np.where(total > 0, s / np.where(total > 0, total, 1), 1.0 / s.shape[1])[np.arange(len(x)), y.astype(int)]
        return -np.log(np.clip(p, LEAST_PROBABILITY, None)) + l2 * float((((v - start) / width) ** 2).mean())

    return loss


def midpoint(model: Model, values: np.ndarray | Callable[[np.ndarray], np.ndarray], base: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Midpoint of a type-2 prediction, as a function of rows and of a width for each membership.

    The upper model widens deviations by 1 + w / 2, the lower narrows them to
    max(0.1, 1 - w), so lower never exceeds upper. `values`: one a label, or a
    function of the rows that gives one a row and label.
    """
    sig = np.arange(1, len(base), 2)
    of = values if callable(values) else lambda x: np.broadcast_to(values, (len(x), len(values)))

    def mid(x, w):
        out, own = 0.0, of(x)
        for scale in (1 + w / 2, np.maximum(membership.LEAST_LOWER_SCALE, 1 - w)):
            v = base.copy()
            v[sig] = base[sig] * scale
            s = firing_np(model, x, v)
            t = s.sum(axis=1)
            out = out + np.where(t <= ZERO_FIRING, 0.0, (s * own).sum(axis=1) / np.where(t > 0, t, 1)) / 2
        return out

    return mid


def interval_loss(model: Model, values: np.ndarray, base: np.ndarray) -> Loss:
    """Squared error of the midpoint; the vector holds the widths."""
    mid = midpoint(model, values, base)
    return lambda x, y, w: (y - mid(x, w)) ** 2


def plane_loss(model: Model, values: np.ndarray, base: np.ndarray, planes: int = 5) -> Loss:
    """As `interval_loss` over alpha planes: widths shrink to the principal model as alpha nears 1."""
    mid, alphas = midpoint(model, values, base), [(k + 1) / planes for k in range(planes)]
    return lambda x, y, w: (y - sum(a * mid(x, w * (1 - a)) for a in alphas) / sum(alphas)) ** 2


def knot_loss(knots: dict[str, list[float]], rules: list[tuple[int, dict[str, list[int]]]], n_labels: int) -> Loss:
    """Cross-entropy of a shared-knot partition; the vector holds all knots, feature by feature."""

    def loss(x, y, v):
        at, acts = 0, {}
        for i, (f, k) in enumerate(knots.items()):
            ks = np.sort(v[at : at + len(k)])
            at += len(k)
            acts[f] = np.stack([np.interp(x[:, i], ks, e) for e in np.eye(len(k))], axis=1)
        s = np.zeros((len(x), n_labels))
        for label, clauses in rules:
            r = np.ones(len(x))
            for f, ts in clauses.items():
                r *= 1 - np.prod(1 - acts[f][:, ts], axis=1)
            s[:, label] += r
        t = s.sum(axis=1, keepdims=True)
        p = np.where(t > 0, s / np.where(t > 0, t, 1), 1.0 / n_labels)[np.arange(len(x)), y.astype(int)]
        return -np.log(np.clip(p, LEAST_PROBABILITY, None))

    return loss


# ------------------------------------------------------------ searches


Evaluate = Callable[[np.ndarray], np.ndarray]


def coordinate_descent(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, block: int = 2, sweeps: int = 3, step: float = 0.1) -> tuple[np.ndarray, float]:
    """Moves blocks of parameters: a sweep is two passes.

    The first tries every move of every block alone; the second the improving
    blocks together, best first, in growing numbers. Only a strict decrease is
    kept; a sweep without one halves the step.
    """
    x, width = np.clip(start, box[:, 0], box[:, 1]), box[:, 1] - box[:, 0]
    value = float(evaluate(x[None])[0])
    moves = [m for m in np.array(np.meshgrid(*[[-1, 0, 1]] * block)).T.reshape(-1, block) if np.any(m)]
    for _ in range(sweeps):
        tries, places = [], []
        for at in range(0, len(x), block):
            for m in moves:
                c = x.copy()
                n = min(block, len(x) - at)
                c[at : at + n] = np.clip(c[at : at + n] + m[:n] * step * width[at : at + n], box[at : at + n, 0], box[at : at + n, 1])
                tries.append(c)
                places.append(at)
        got = evaluate(np.array(tries))
        best: dict[int, tuple[float, int]] = {}
        for i, (at, v) in enumerate(zip(places, got, strict=True)):
            if v < value - LEAST_DECREASE and v < best.get(at, (np.inf, 0))[0]:
                best[at] = (float(v), i)
        if not best:
            step /= 2
            continue
        order, joint, c = sorted(best.items(), key=lambda kv: kv[1]), [], x.copy()
        for at, (_, i) in order:
            c = c.copy()
            c[at : at + block] = tries[i][at : at + block]
            joint.append(c)
        vals = evaluate(np.array(joint))
        k = int(vals.argmin())
        if vals[k] < value - LEAST_DECREASE:
            x, value = joint[k], float(vals[k])
    return x, value


def genetic(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, population: int = 20, generations: int = 10, blend: float = 0.5, rate: float = 0.1, seed: int = 42) -> tuple[np.ndarray, float]:
    """Tournaments of three, BLX crossover, Gaussian mutation and one elite; a generation is one pass.

    Never worse than the start, which is in the first generation.
    """
    rng, lo, hi = np.random.default_rng(seed), box[:, 0], box[:, 1]
    pop = np.clip(start + rng.normal(0, 0.1, (population, len(start))) * (hi - lo), lo, hi)
    pop[0] = np.clip(start, lo, hi)
    fit = evaluate(pop)
    for _ in range(generations):
        elite = pop[fit.argmin()].copy()
        pick = lambda: pop[min(rng.integers(0, population, 3), key=lambda i: fit[i])]
        kids = []
        for _ in range(population - 1):
            a, b = pick(), pick()
            low, d = np.minimum(a, b), np.abs(a - b)
            kid = rng.uniform(low - blend * d, low + d + blend * d)
            hit = rng.random(len(kid)) < rate
            kids.append(np.clip(kid + hit * rng.normal(0, 0.1, len(kid)) * (hi - lo), lo, hi))
        pop = np.array([elite, *kids])
        fit = evaluate(pop)
    return pop[fit.argmin()], float(fit.min())


def projected_gradient(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, steps: int = 10, h: float = 1e-4) -> tuple[np.ndarray, float]:
    """Central differences in box widths (one pass), then all Armijo step lengths at once (one pass)."""
    width = np.maximum(box[:, 1] - box[:, 0], 1e-12)
    x = np.clip(start, box[:, 0], box[:, 1])
    value = float(evaluate(x[None])[0])
    for _ in range(steps):
        probe = np.array([np.clip(x + s * h * width * e, box[:, 0], box[:, 1]) for e in np.eye(len(x)) for s in (1, -1)])
        got = evaluate(probe).reshape(-1, 2)
        gap = np.abs(probe[0::2] - probe[1::2]).sum(axis=1) / width
        g = (got[:, 0] - got[:, 1]) / np.maximum(gap, 1e-12)
        norm = float(g @ g)
        if norm < 1e-18:
            break
        lengths = [0.5**k for k in range(12)]
        tries = np.array([np.clip(x - t * width * g / math.sqrt(norm), box[:, 0], box[:, 1]) for t in lengths])
        vals = evaluate(tries)
        ok = [k for k in range(len(lengths)) if vals[k] <= value - 1e-4 * lengths[k] * math.sqrt(norm)]
        if not ok:
            break
        x, value = tries[ok[0]], float(vals[ok[0]])
    return x, value


def swarm(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, population: int = 20, generations: int = 10, inertia: float = 0.7, pull: float = 1.5, seed: int = 42) -> tuple[np.ndarray, float]:
    """Particles drawn to their own best and the best of all; a move of the swarm is one pass."""
    rng, lo, hi = np.random.default_rng(seed), box[:, 0], box[:, 1]
    x = np.clip(start + rng.normal(0, 0.1, (population, len(start))) * (hi - lo), lo, hi)
    x[0] = np.clip(start, lo, hi)
    v, own = np.zeros_like(x), x.copy()
    best = evaluate(x)
    for _ in range(generations):
        top = own[best.argmin()]
        v = inertia * v + pull * rng.random(x.shape) * (own - x) + pull * rng.random(x.shape) * (top - x)
        x = np.clip(x + v, lo, hi)
        got = evaluate(x)
        better = got < best
        own[better], best[better] = x[better], got[better]
    return own[best.argmin()], float(best.min())


def ant_colony(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, population: int = 20, generations: int = 10, locality: float = 0.3, spread: float = 0.85, seed: int = 42) -> tuple[np.ndarray, float]:
    """Continuous ant colony: an archive of solutions, each parameter drawn about one of them; a generation is one pass."""
    rng, lo, hi = np.random.default_rng(seed), box[:, 0], box[:, 1]
    archive = np.clip(start + rng.normal(0, 0.1, (population, len(start))) * (hi - lo), lo, hi)
    archive[0] = np.clip(start, lo, hi)
    value = evaluate(archive)
    rank = np.exp(-(np.arange(population) ** 2) / (2 * (locality * population) ** 2))
    for _ in range(generations):
        order = np.argsort(value, kind="stable")
        archive, value = archive[order], value[order]
        pick = rng.choice(population, (population, len(start)), p=rank / rank.sum())
        centre = np.take_along_axis(archive, pick, axis=0)
        width = spread * np.abs(archive[None] - centre[:, None]).sum(axis=1) / max(population - 1, 1)
        ants = np.clip(rng.normal(centre, np.maximum(width, 1e-12)), lo, hi)
        both, vals = np.concatenate([archive, ants]), np.concatenate([value, evaluate(ants)])
        keep = np.argsort(vals, kind="stable")[:population]
        archive, value = both[keep], vals[keep]
    return archive[0], float(value[0])


def population_search(evaluate: Evaluate, start: np.ndarray, box: np.ndarray, method: str = "ga", share: float = 0.5, **options) -> tuple[np.ndarray, float]:
    """ga, pso, aco, or multi (the best of the three) in a box of `share` of the width around the start.

    Never worse than the start.
    """
    half = (box[:, 1] - box[:, 0]) * share / 2
    near = np.stack([np.maximum(box[:, 0], start - half), np.minimum(box[:, 1], start + half)], axis=1)
    ways = {"ga": genetic, "pso": swarm, "aco": ant_colony}
    if method != "multi" and method not in ways:
        raise ValueError(f"unknown search: {method}")
    found = [ways[m](evaluate, start, near, **options) for m in (ways if method == "multi" else [method])]
    return min([(np.asarray(start, float), float(evaluate(np.asarray(start, float)[None])[0])), *found], key=lambda r: r[1])


def refine_classifier(df: DataFrame, model: Model, label: str, method: str = "coordinate", l2: float = 0.05, **options) -> tuple[Model, float]:
    """The model with memberships moved to lessen cross-entropy; `method`: coordinate, local, ga, pso, aco or multi."""
    number = F.array_position(F.array(*map(F.lit, model.labels)), F.col(label)) - 1
    rows = df.withColumn("__label", number).where(F.col("__label") >= 0)
    x0, box = to_vector(model), bounds(df, model)
    loss = cross_entropy(model, x0, box, l2)
    ways = {"coordinate": coordinate_descent, "ga": genetic, "local": projected_gradient}
    search = ways.get(method) or (lambda *a, **o: population_search(*a, method=method, **o))
    v, value = search(lambda c: mean_loss(rows, model.features, "__label", loss, c), x0, box, **options)
    return from_vector(model, v), value


def refine_regressor(df: DataFrame, regressor, folds: int = 3, fold: Column | None = None, method: str = "coordinate", **options) -> float:
    """Moves a TSK regressor's memberships to lessen its cross-validated squared error; returns that.

    Every candidate gets consequents of its own: a pass sums its Gram matrix
    by fold, and what the other folds solve is scored on each fold's matrix
    alone. Rows are dealt to folds by `fold`, or by a hash of all they hold.
    """
    features, model, n = regressor.features, regressor.model, len(regressor.model.labels)
    terms = regressor.terms()
    fold = F.pmod(F.xxhash64(*df.columns), F.lit(folds)) if fold is None else fold
    rows = df.select(fold.cast("int").alias("f"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.array(F.lit(1.0), *terms).alias("p"), F.col(regressor.target).cast("double").alias("y"))
    bad = lambda v: v.isNull() | F.isnan(v)
    rows = rows.where(~F.exists("x", bad) & ~F.exists("p", bad) & ~bad(F.col("y")))
    block = 1 + len(terms)
    size = n * block + 1
    order = [model.features.index(f) for f in features]

    def grams(candidates: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, fire = np.zeros((len(candidates), folds, size, size)), IncrementalFiring(model)
            for b in batches:
                if not b.num_rows:
                    continue
                x, p = (np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (1, 2))
                own = np.empty_like(x)
                own[:, order] = x
                at, y = b.column(0).to_numpy(), b.column(3).to_numpy()
                for c, v in enumerate(candidates):
                    s = fire(own, v)
                    t = s.sum(axis=1, keepdims=True)
                    w = np.where(t <= ZERO_FIRING, 0.0, s / np.where(t > 0, t, 1))
                    d = np.column_stack([(w[:, :, None] * p[:, None, :]).reshape(len(p), -1), y])
                    for k in range(folds):
                        part = d[at == k]
                        total[c, k] += part.T @ part
            yield at_places(total.ravel())

        return sum_places(rows.mapInArrow(run, "i long, v double"), len(candidates) * folds * size * size).reshape(len(candidates), folds, size, size)

    count = max(rows.count(), 1)

    def evaluate(candidates: np.ndarray) -> np.ndarray:
        from hazelogic.operators import tsk

        out = []
        for g in grams(candidates):
            whole, err = g.sum(axis=0), 0.0
            for k in range(folds):
                rest = whole - g[k]
                means, more = tsk.solve(rest[:-1, :-1], rest[:-1, -1], n, regressor.l2)
                beta = np.append(np.column_stack([means, more]).ravel(), -1.0)
                err += float(beta @ g[k] @ beta)
            out.append(err / count)
        return np.array(out)

    start, box = to_vector(model), bounds(df, model)
    search = {"coordinate": coordinate_descent, "local": projected_gradient}.get(method) or (lambda *a, **o: population_search(*a, method=method, **o))
    v, value = search(evaluate, start, box, **options)
    regressor.model = from_vector(model, v)
    regressor.resolve(df)
    return value


def refine_widths(df: DataFrame, estimator, most: float = 0.9, **options) -> float:
    """Moves the width of every membership of a `Type2Regressor` to lessen the squared error of its middle; returns that.

    One width a membership keeps the lower bound below the upper; with planes
    the principal membership stays where it is.
    """
    from hazelogic.operators import type2

    base, features = estimator.base, estimator.base.model.features
    means, more = np.asarray(base.means), np.asarray(base.corrections)
    terms = [t.alias(f"t{i}") for i, t in enumerate(base.terms())]
    rows = df.select(*features, *terms, F.col(estimator.target).alias("__y"))
    k = len(features)
    values = lambda x: means + x[:, k:] @ more.T if more.shape[1] else np.broadcast_to(means, (len(x), len(means)))
    vector = to_vector(base.model)
    make = plane_loss if estimator.planes else interval_loss
    loss = make(base.model, values, vector, *([estimator.planes] if estimator.planes else []))
    start = np.full(len(vector) // 2, estimator.width)
    box = np.tile([0.0, most], (len(start), 1))
    v, value = coordinate_descent(lambda c: mean_loss(rows, [*features, *[f"t{i}" for i in range(len(terms))]], "__y", loss, c), start, box, block=1, **options)
    estimator.model = type2.Type2.of(base.model, type2.widths_like(base.model, v), estimator.planes > 0)
    return value


def refine_partition(df: DataFrame, part, label: str, labels: list[str], guard: str = "legacy", **options):
    """A partition with its knots moved to lessen cross-entropy, kept only if the guard accepts it; and the loss."""
    from hazelogic.operators import infer, rulebase

    names = list(part.knots)
    rules = [(labels.index(r.label), r.clauses) for r in part.ruleset]
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    rows = df.withColumn("__label", number).where(F.col("__label") >= 0)
    loss = knot_loss(part.knots, rules, len(labels))
    start = np.array([k for f in names for k in part.knots[f]])
    box = np.array([(ks[max(i - 1, 0)], ks[min(i + 1, len(ks) - 1)]) for ks in part.knots.values() for i in range(len(ks))])
    evaluate = lambda c: mean_loss(rows, names, "__label", loss, c)
    before = float(evaluate(start[None])[0])
    v, after = coordinate_descent(evaluate, start, box, block=1, **options)
    it = iter(map(float, v))
    moved = rulebase.Partition({f: sorted(next(it) for _ in part.knots[f]) for f in names}, part.ruleset)
    both = rows.select(label, *[infer.classify(rulebase.partition_probabilities(p, labels), labels).alias(n) for n, p in (("__b", part), ("__a", moved))])
    r = paired_counts(both, label, "__b", "__a").first()
    return (moved, after) if accept(guard, r.n, r.only_before, r.only_after, before, after) else (part, before)


# ------------------------------------------------------------ gradients and guards


def firing_gradient(model: Model, feature: str, label: str, k: int = 0) -> tuple[Column, Column]:
    """Derivatives of a label's strength by mu and sigma of one membership (probability family)."""
    mu, sigma = model.cells[feature, label][k]
    sigma = max(sigma, membership.SIGMA_FLOOR)
    cell = lambda f, skip=None: [1 - membership.gaussian(F.col(f).cast("double"), m, s) for i, (m, s) in enumerate(model.cells.get((f, label), [])) if i != skip]
    scale = F.lit(1.0)
    for miss in cell(feature, k):
        scale = scale * miss
    for f in model.features:
        if f != feature:
            gone = F.lit(1.0)
            for miss in cell(f):
                gone = gone * miss
            scale = scale * (1 - gone)
    d = F.col(feature).cast("double") - mu
    slope = scale * membership.gaussian(F.col(feature).cast("double"), mu, sigma)
    return slope * d / sigma**2, slope * d * d / sigma**3


def paired_counts(df: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """One row: n, both_right, only_before, only_after."""
    b, a = F.col(before).eqNullSafe(F.col(truth)), F.col(after).eqNullSafe(F.col(truth))
    return df.agg(F.count("*").alias("n"), F.count(F.when(b & a, 1)).alias("both_right"), F.count(F.when(b & ~a, 1)).alias("only_before"), F.count(F.when(~b & a, 1)).alias("only_after"))


def mcnemar_p(only_before: int, only_after: int) -> float:
    """Two-sided exact binomial p-value of the discordant pairs."""
    n, k = only_before + only_after, min(only_before, only_after)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def accept(guard: str, n: int, only_before: int, only_after: int, ce_before: float, ce_after: float, alpha: float = 0.10) -> bool:
    """Whether a refinement is kept: none, legacy, effect-size, mcnemar or ce."""
    better, tied, lower = only_after > only_before, only_after == only_before, ce_after < ce_before
    if guard == "none":
        return True
    if guard == "ce":
        return lower
    if guard == "legacy":
        return better or (tied and lower)
    if guard == "effect-size":
        mean = (only_after - only_before) / max(n, 1)
        var = ((only_after + only_before) - n * mean * mean) / (n - 1) if n > 1 else 0.0
        return lower if tied else mean > math.sqrt(max(var, 0.0) / max(n, 1)) * (1 + 1e-9)
    if guard == "mcnemar":
        return lower if tied else better and mcnemar_p(only_before, only_after) < alpha
    raise ValueError(f"unknown guard: {guard}")


# ------------------------------------------------------------ EM of experts


def em_experts(df: DataFrame, features: list[str], target: str, start: list[float] | list[list[float]], rounds: int = 15, tol: float = 1e-4, min_mass: float = 1.0, l2: float = 1e-6) -> dict[str, np.ndarray]:
    """Linear experts behind Gaussian gates, by EM; a round is one pass.

    `start` gives each expert's first gate mean, a number for gates on the
    first feature or a list for gates on as many of the first features. The E-step works on logs; a task sends
    back for each expert the weighted Gram matrix of [1, features, target]. An
    expert of less than `min_mass` rows keeps its parameters, and the round of
    the best likelihood is returned: gate_mu, gate_sigma, share, beta, noise, log_likelihood.
    """
    cols = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    rows = rows.where(~F.exists(F.array(*rows.columns), lambda v: v.isNull() | F.isnan(v)))
    flat = np.ndim(start[0]) == 0
    begin = np.array(start, float).reshape(len(start), -1)
    first = rows.agg(F.avg(f"c{len(features)}"), F.stddev_pop(f"c{len(features)}"), *[F.stddev_pop(f"c{i}") for i in range(begin.shape[1])]).first()
    (k, gates), p = begin.shape, len(features) + 1
    mean_y, sd_y, sd = (first[0] or 0.0), (first[1] or 1.0), np.array([v or 1.0 for v in first[2:]])
    state = {"gate_mu": begin, "gate_sigma": np.tile(sd / k, (k, 1)), "share": np.full(k, 1.0 / k), "beta": np.tile(np.append(mean_y, np.zeros(p - 1)), (k, 1)), "noise": np.full(k, sd_y)}

    best, best_ll, last = state, -np.inf, -np.inf
    for _ in range(rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], s=state) -> Iterator[pa.RecordBatch]:
            gram, ll = np.zeros((k, p + 1, p + 1)), 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                z = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                v = np.column_stack([np.ones(len(z)), z])
                logn = lambda x, m, d: -0.5 * ((x - m) / d) ** 2 - np.log(d) - 0.5 * math.log(2 * math.pi)
                w = np.log(s["share"]) + logn(z[:, None, :gates], s["gate_mu"], s["gate_sigma"]).sum(axis=2) + logn(z[:, -1:], v[:, :-1] @ s["beta"].T, s["noise"])
                top = w.max(axis=1, keepdims=True)
                total = top + np.log(np.exp(w - top).sum(axis=1, keepdims=True))
                ll += float(total.sum())
                gram += np.einsum("nk,ni,nj->kij", np.exp(w - total), v, v)
            yield at_places(np.append(gram.ravel(), ll))

        sums = sum_places(rows.mapInArrow(run, "i long, v double"), k * (p + 1) ** 2 + 1)
        gram, ll = sums[:-1].reshape(k, p + 1, p + 1), float(sums[-1])
        if ll > best_ll:
            best, best_ll = state, ll
        if ll - last < tol * max(abs(last), 1.0) and np.isfinite(last):
            break
        last = ll
        new = {n: x.copy() for n, x in state.items()}
        mass = gram[:, 0, 0]
        for i in np.flatnonzero(mass >= min_mass):
            g = gram[i]
            penalty = np.diag([0.0] + [l2] * (p - 1))
            b = np.linalg.lstsq(g[:p, :p] + penalty, g[:p, p], rcond=None)[0]
            e = np.append(-b, 1.0)
            new["beta"][i], new["noise"][i] = b, max(math.sqrt(max(e @ g @ e, 0.0) / mass[i]), 1e-3 * sd_y)
            own = np.arange(1, gates + 1)
            mu = g[0, own] / mass[i]
            new["gate_mu"][i], new["gate_sigma"][i] = mu, np.maximum(np.sqrt(np.maximum(g[own, own] / mass[i] - mu * mu, 0.0)), 1e-3 * sd)
        new["share"] = np.maximum(mass, 1e-12) / max(mass.sum(), 1e-12)
        state = new
    if flat:
        best = best | {n: best[n][:, 0] for n in ("gate_mu", "gate_sigma")}
    return best | {"log_likelihood": np.array(best_ll)}
