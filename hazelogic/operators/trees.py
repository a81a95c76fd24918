"""Soft trees and crisp partition trees, grown a level at a time.

A level costs two jobs, whatever the number of rows: a histogram of every
feature weighted by the membership in every open node, from which knots come,
and the sums that score all splits of all nodes. Both combine inside the tasks
and send at most nodes x features x bins numbers to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.functions import norms
from hazelogic.operators.infer import ZERO_FIRING, normalised

#: Bins of the histogram that knots are read from.
KNOT_BINS = 1024
#: Neighbouring knots nearer than this share of the span give way to even spacing.
LEAST_GAP = 1e-3
#: Terms of a split are named from the left.
NAMES = ("Low", "Med", "High")


@dataclass
class Node:
    """A split (feature, knots, children) or, without children, a leaf."""

    path: tuple[int, ...] = ()
    conditions: list[tuple[str, list[float], int]] = field(default_factory=list)
    feature: str | None = None
    knots: list[float] | None = None
    gain: float = 0.0
    mass: float = 0.0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def soft_terms(x: Column, knots: list[float]) -> list[Column]:
    """Bands between knots with ramps of half a band outwards; open at both ends."""
    out, n = [], len(knots) - 1
    for i in range(n):
        lo, hi = knots[i], knots[i + 1]
        ramp = 0.5 * (hi - lo)
        left = F.when(x >= lo, 1.0).when((x > lo - ramp) & F.lit(ramp > 0), (x - (lo - ramp)) / (ramp or 1.0)).otherwise(0.0) if i else F.lit(1.0)
        right = F.when(x <= hi, 1.0).when((x < hi + ramp) & F.lit(ramp > 0), (hi + ramp - x) / (ramp or 1.0)).otherwise(0.0) if i < n - 1 else F.lit(1.0)
        out.append(F.least(left, right))
    return out


def _soft(x: np.ndarray, knots: list[float]) -> np.ndarray:
    n, out = len(knots) - 1, []
    for i in range(n):
        lo, hi = knots[i], knots[i + 1]
        ramp = 0.5 * (hi - lo)
        xs, ys = [], []
        if i:
            xs, ys = [lo - ramp, lo], [0.0, 1.0]
        if i < n - 1:
            xs, ys = [*xs, hi, hi + ramp], [*ys, 1.0, 0.0]
        out.append(np.interp(x, xs, ys) if xs else np.ones_like(x))
    return np.stack(out, axis=1)


def knots_of(mass: np.ndarray, centre: np.ndarray, n_terms: int) -> list[float]:
    """Weighted quantiles of binned values (midpoints of the cumulative mass); none without spread."""
    held = mass > mass.max(initial=0.0) * 1e-6
    if held.sum() < 2:
        return []
    m, c = mass[held], centre[held]
    mid = (np.cumsum(m) - m / 2) / m.sum()
    lo, hi = float(c[0]), float(c[-1])
    got = np.interp(np.linspace(0, 1, n_terms + 1), mid, c)
    if np.any(np.diff(got) < (hi - lo) * LEAST_GAP):
        got = np.linspace(lo, hi, n_terms + 1)
    return [float(k) for k in got]


def _rows(b: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)


def _weights(x: np.ndarray, names: list[str], nodes: list[Node]) -> np.ndarray:
    out = np.ones((len(x), len(nodes)))
    for j, node in enumerate(nodes):
        for f, knots, term in node.conditions:
            out[:, j] *= _soft(x[:, names.index(f)], knots)[:, term]
    return out


def _summed(df: DataFrame, cols: list[str], stats, size: int) -> np.ndarray:
    """Sum over all rows of a vector that each batch adds to; one vector leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += stats(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["k", "v"])

    out = np.zeros(size)
    for r in df.select(*cols).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # at most `size` rows
        out[r.k] = r.v
    return out


def nonspecificity(mass: np.ndarray) -> float:
    """U-uncertainty of class masses taken as possibilities."""
    if mass.sum() <= 1e-12:
        return 0.0
    p = np.append(np.sort(mass / mass.max())[::-1], 0.0)
    return float(((p[:-1] - p[1:]) * np.log(np.arange(1, len(p)))).sum())


def _entropy(mass: np.ndarray) -> float:
    p = mass[mass > 0] / mass.sum() if mass.sum() > 0 else np.zeros(0)
    return float(-(p * np.log2(p)).sum())


def class_gain(node: np.ndarray, terms: np.ndarray, measure) -> float:
    """A measure of class masses in the node less its mean over soft children (terms x classes)."""
    mass = terms.sum(axis=1)
    if mass.sum() <= 1e-12:
        return 0.0
    return measure(node) - sum(m / mass.sum() * measure(t) for m, t in zip(mass, terms, strict=True))


def _variance_gain(s: np.ndarray) -> float:
    """`s`: a row for the node, then one for each term, of sums of w, wy and wy²."""
    var = lambda r: max(r[2] / r[0] - (r[1] / r[0]) ** 2, 0.0) if r[0] > 1e-12 else 0.0
    parent, total = var(s[0]), s[1:, 0].sum()
    return 0.0 if parent <= 1e-12 or total <= 1e-12 else (parent - sum(r[0] / total * var(r) for r in s[1:])) / parent


def separation(sums: np.ndarray, lo: float, hi: float) -> float:
    """How apart classes lie by weighted sums of 1, x and x² (rows) for each class (columns).

    For each pair of classes normal densities on 100 points of [lo, hi] are
    compared by 1 - their Bhattacharyya coefficient, by Jensen-Shannon distance
    and by 1 - overlap; the pair's score is the middle of the arithmetic and
    the geometric mean of the three.
    """
    mass = sums[0]
    if hi - lo <= 1e-12:
        return 0.0
    grid, shares = np.linspace(lo, hi, 100), []
    for m, s, q in sums.T:
        if m <= 1e-12:
            shares.append(None)
            continue
        mu = s / m
        sigma = max(np.sqrt(max(q / m - mu * mu, 0.0)), 1e-6)
        p = np.exp(-0.5 * ((grid - mu) / sigma) ** 2) / sigma
        shares.append(p / p.sum() if p.sum() > 1e-12 else None)
    total = 0.0
    for a in range(len(mass)):
        for b in range(a + 1, len(mass)):
            p, q = shares[a], shares[b]
            if p is None or q is None:
                continue
            mid = np.maximum((p + q) / 2, 1e-300)
            kl = lambda u, mid=mid: float((u * np.log(np.maximum(u, 1e-300) / mid)).sum())
            three = np.maximum([1 - np.sqrt(p * q).sum(), np.sqrt(max((kl(p) + kl(q)) / 2, 0.0)), 1 - np.minimum(p, q).sum()], 0.0)
            total += (three.mean() + three.prod() ** (1 / 3)) / 2
    return float(total)


def grow(df: DataFrame, features: list[str], target: str, criterion: str = "variance", max_depth: int = 3, n_terms: int = 3, min_mass: float = 5.0, min_gain: float = 1e-3, max_leaves: int = 64, plan: dict[tuple[int, ...], str] | None = None) -> Node:
    """A soft tree. `criterion`: variance (numeric target), ambiguity, information or differentiation (classes).

    Differentiation ranks features by how apart the classes lie on them in the
    node's rows (see `separation`), whatever the terms.

    `plan` pins the feature of a path. Rows with a null or NaN in a feature or
    the target are left out. Leaves are granted in level order; a feature is
    used once on a path. Knots are read from a histogram of equal-width bins,
    so they are exact for features of up to `KNOT_BINS` evenly spread values.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], target)
    rows = rows.where(F.lit(True) if not features else ~F.exists(F.array(*features), lambda v: v.isNull() | F.isnan(v))).where(F.col(target).isNotNull())
    classes = [] if criterion == "variance" else sorted(r[0] for r in rows.select(target).distinct().limit(1001).collect())
    if len(classes) > 1000:
        raise ValueError("a tree takes at most 1000 classes")
    rows = rows.withColumn("__y", F.col(target).cast("double") if not classes else (F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1).cast("double"))
    ends = rows.agg(*[g(f) for f in features for g in (F.min, F.max)]).first()
    lo = np.array([ends[2 * i] if ends[2 * i] is not None else 0.0 for i in range(len(features))])
    span = np.array([(ends[2 * i + 1] or 0.0) - lo[i] if ends[2 * i] is not None else 0.0 for i in range(len(features))])
    n_f, n_s = len(features), len(classes) or 3
    root, level, leaves = Node(), None, 1
    level = [root]
    for _ in range(max_depth + 1):
        shape = (len(level), n_f, KNOT_BINS, 2)

        def binned(b, nodes=level, shape=shape):
            x = _rows(b, n_f)
            w, out = _weights(x, features, nodes), np.zeros(shape)
            for f in range(n_f):
                at = np.clip((x[:, f] - lo[f]) / (span[f] or 1.0) * KNOT_BINS, 0, KNOT_BINS - 1).astype(int)
                for j in range(len(nodes)):
                    out[j, f, :, 0] += np.bincount(at, w[:, j], KNOT_BINS)
                    out[j, f, :, 1] += np.bincount(at, w[:, j] * x[:, f], KNOT_BINS)
            return out.ravel()

        hist = _summed(rows, [*features, "__y"], binned, math.prod(shape)).reshape(shape)
        cuts: dict[tuple[int, int], list[float]] = {}
        for j, node in enumerate(level):
            node.mass = float(hist[j, 0, :, 0].sum()) if n_f else 0.0
            used = {f for f, _, _ in node.conditions}
            if node.mass < min_mass or len(node.path) >= max_depth:
                continue
            for f, name in enumerate(features):
                pinned = (plan or {}).get(node.path)
                if name in used or (pinned and pinned != name):
                    continue
                m = hist[j, f, :, 0]
                knots = knots_of(m, np.divide(hist[j, f, :, 1], m, out=np.zeros_like(m), where=m > 0), n_terms)
                if knots:
                    cuts[j, f] = knots
        if not cuts:
            break
        keys = list(cuts)
        apart = criterion == "differentiation"
        size = (len(keys), 3 if apart else n_terms + 1, n_s)

        def scored(b, nodes=level, keys=keys, cuts=cuts, size=size):
            x, y = _rows(b, n_f), b.column(n_f).to_numpy(zero_copy_only=False)
            w, out = _weights(x, features, nodes), np.zeros(size)
            per = np.eye(n_s)[y.astype(int)] if classes else np.stack([np.ones_like(y), y, y * y], axis=1)
            for i, (j, f) in enumerate(keys):
                t = np.column_stack([np.ones(len(y)), x[:, f], x[:, f] ** 2] if apart else [np.ones(len(y)), _soft(x[:, f], cuts[j, f])]) * w[:, j : j + 1]
                out[i] += t.T @ per
            return out.ravel()

        sums = _summed(rows, [*features, "__y"], scored, math.prod(size)).reshape(size)
        measure = nonspecificity if criterion == "ambiguity" else _entropy
        after: list[Node] = []
        for j, node in enumerate(level):
            gains = [(separation(s, lo[f], lo[f] + span[f]) if apart else class_gain(s[0], s[1:], measure) if classes else _variance_gain(s), -f, f) for (jj, f), s in zip(keys, sums, strict=True) if jj == j]
            if not gains:
                continue
            gain, _, f = max(gains)
            if (gain < min_gain and node.path not in (plan or {})) or leaves + n_terms - 1 > max_leaves:
                continue
            leaves += n_terms - 1
            node.feature, node.knots, node.gain = features[f], cuts[j, f], gain
            node.children = [Node((*node.path, t), [*node.conditions, (features[f], cuts[j, f], t)]) for t in range(n_terms)]
            after += node.children
        if not after:
            break
        level = after
    return root


def prune(node: Node, alpha: float) -> Node:
    """Collapses splits whose own gain is below `alpha`, from the bottom up; other gains stay as they are."""
    kids = [prune(c, alpha) for c in node.children]
    if kids and node.gain < alpha and all(not c.children for c in kids):
        return Node(node.path, node.conditions, mass=node.mass)
    return Node(node.path, node.conditions, node.feature, node.knots, node.gain, node.mass, kids)


def leaf_firing(tree: Node, family: str = "probability") -> Column:
    """Array over leaves, left to right: the t-norm of the memberships on the path."""
    return F.array(*_strengths(tree, family))


def leaf_values(df: DataFrame, tree: Node, target: str) -> list[float]:
    """Firing-weighted mean of the target for each leaf; the overall mean where nothing fires."""
    n = len(tree.leaves())
    rows = df.select(leaf_firing(tree).alias("w"), F.col(target).cast("double").alias("y")).where("y is not null")
    got = rows.agg(F.avg("y"), *[F.sum(F.get("w", F.lit(i)) * F.col("y")) / F.nullif(F.sum(F.get("w", F.lit(i))), F.lit(0.0)) for i in range(n)]).first()
    return [float(v if v is not None else got[0] or 0.0) for v in got[1:]]


def leaf_classes(df: DataFrame, tree: Node, target: str, classes: list) -> list[list[float]]:
    """Share of each class in the soft mass of each leaf."""
    n = len(tree.leaves())
    rows = df.select(leaf_firing(tree).alias("w"), F.col(target).alias("y")).where("y is not null")
    got = {r.y: r for r in rows.groupBy("y").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(n)]).collect()}  # one row a class
    out = []
    for i in range(n):
        mass = [float(got[c][f"w{i}"] or 0.0) if c in got else 0.0 for c in classes]
        out.append([m / sum(mass) if sum(mass) > 0 else 1.0 / len(classes) for m in mass])
    return out


def _strengths(tree: Node, family: str = "probability") -> list[Column]:
    return [norms.fold_and([soft_terms(F.col(f).cast("double"), k)[t] for f, k, t in leaf.conditions], family) if leaf.conditions else F.lit(1.0) for leaf in tree.leaves()]


def _blended(w: list[Column], values: list[float]) -> Column:
    total = sum(w[1:], w[0])
    value = sum((x * v for x, v in zip(w[1:], values[1:], strict=True)), w[0] * values[0])
    return F.when(total > ZERO_FIRING, value / total).otherwise(math.fsum(values) / len(values))


def predict(tree: Node, values: list[float]) -> Column:
    """Firing-weighted leaf value; the mean of the leaves where none fires.

    Plain sums, so that strengths are common subexpressions and computed once.
    """
    return _blended(_strengths(tree), values)


def predict_proba(tree: Node, shares: list[list[float]]) -> Column:
    """Array over classes; the mean of the leaf distributions where none fires."""
    w = _strengths(tree)
    return F.array(*[_blended(w, [s[c] for s in shares]) for c in range(len(shares[0]))])


def leaf_consequents(df: DataFrame, tree: Node, features: list[str], target: str, l2: float = 1e-6) -> np.ndarray:
    """Leaves x (1 + features) coefficients: ridge on normalised leaf firing times [1, features], intercepts free."""
    from hazelogic.operators import tsk

    n, w = len(tree.leaves()), normalised(leaf_firing(tree))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    xx, xy, _ = tsk.gram(df, F.flatten(F.transform(w, lambda v: F.transform(x, lambda t: v * t))), F.col(target))
    return np.column_stack(tsk.solve(xx, xy, n, l2))


def describe(node: Node, values: list[float] | None = None) -> str:
    """The tree as indented text."""
    order = {id(x): i for i, x in enumerate(node.leaves())}

    def lines(x: Node, depth: int) -> list[str]:
        pad = "  " * depth
        if not x.children:
            tail = f" -> {values[order[id(x)]]:.4g}" if values else ""
            return [f"{pad}leaf {order[id(x)]} (mass {x.mass:.1f}){tail}"]
        names = NAMES if len(x.children) == len(NAMES) else [f"L{i}" for i in range(len(x.children))]
        out = [f"{pad}{x.feature} (gain {x.gain:.4f})"]
        for name, c in zip(names, x.children, strict=True):
            out += [f"{pad} is {name}:", *lines(c, depth + 1)]
        return out

    return "\n".join(lines(node, 0))


# ------------------------------------------------------------ crisp partition trees


def gini_gains(df: DataFrame, label: str, candidates: dict[str, list[float]], node: Column | None = None) -> DataFrame:
    """`node, feature, tau, gain` of every threshold of every feature for every node, in one shuffle."""
    node = F.lit(0) if node is None else node
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("tau"), (F.col(f) <= t).cast("long").alias("left")) for f, ts in candidates.items() for t in sorted(set(ts))]
    long = df.where(F.col(label).isNotNull()).select(node.alias("node"), F.col(label).alias("c"), F.explode(F.array(*pairs)).alias("s"))
    cells = long.groupBy("node", "s.feature", "s.tau", "c").agg(F.coalesce(F.sum("s.left"), F.lit(0)).alias("l"), F.count("*").alias("n"))
    sums = cells.withColumn("r", F.col("n") - F.col("l")).groupBy("node", "feature", "tau").agg(*[F.sum(c).alias(f"s{c}") for c in "nlr"], *[F.sum(F.col(c) * F.col(c).cast("double")).alias(f"q{c}") for c in "nlr"])
    gini = lambda c: F.when(F.col(f"s{c}") > 0, 1 - F.col(f"q{c}") / F.col(f"s{c}") / F.col(f"s{c}")).otherwise(0.0)
    gain = gini("n") - (F.col("sl") * gini("l") + F.col("sr") * gini("r")) / F.col("sn")
    return sums.select("node", "feature", "tau", F.col("sn").alias("n"), gain.alias("gain"))


def bsp_grow(df: DataFrame, features: list[str], label: str, max_depth: int = 10, min_rows: int = 200, min_gain: float = 1e-3, n_quantiles: int = 16) -> dict:
    """`{path: (feature, tau)}` of a crisp tree; a level is one pass, paths are strings of L and R.

    Thresholds are `n_quantiles` approximate quantiles (shares .05 to .95, error
    0.1 % of ranks) of the whole table, so all nodes of a level share a pass.
    """
    shares = [0.05 + 0.9 * k / (n_quantiles - 1) for k in range(n_quantiles)]
    cuts = {f: q for f, q in zip(features, df.approxQuantile(features, shares, 0.001), strict=True) if q}
    splits: dict[str, tuple[str, float]] = {}
    open_ = {""}
    for _ in range(max_depth):
        if not open_ or not cuts:
            break
        at = bsp_route(splits)
        rows = df.withColumn("__n", at).where(F.col("__n").isin(*open_))
        best = gini_gains(rows, label, cuts, F.col("__n")).groupBy("node").agg(F.max(F.struct("gain", "feature", "tau", "n")).alias("b")).collect()  # one row a node
        open_ = set()
        for r in best:
            if r.b.n >= min_rows and r.b.gain >= min_gain:
                splits[r.node] = (r.b.feature, r.b.tau)
                open_ |= {r.node + "L", r.node + "R"}
    return splits


def bsp_route(splits: dict[str, tuple[str, float]], path: str = "") -> Column:
    """The leaf of a row as a path of L (at most tau) and R."""
    if path not in splits:
        return F.lit(path)
    f, tau = splits[path]
    return F.when(F.col(f) <= tau, bsp_route(splits, path + "L")).otherwise(bsp_route(splits, path + "R"))


# ------------------------------------------------------------ experts behind gates


def responsibilities(gates: list[list[Column]]) -> Column:
    """Array over leaves: the product of gate memberships, each normalised within its gate.

    `gates` holds for each level the memberships of its branches; leaves are
    their combinations in order. A gate that does not fire is uniform.
    """
    out = [F.lit(1.0)]
    for g in gates:
        w = normalised(F.array(*g))
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        out = [a * F.when(total > 0, F.get(w, F.lit(i))).otherwise(1.0 / len(g)) for a in out for i in range(len(g))]
    return F.array(*out)


def blend(weights: Column, experts: list[Column]) -> Column:
    """Sum of responsibility times expert."""
    return F.aggregate(F.zip_with(weights, F.array(*experts), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
