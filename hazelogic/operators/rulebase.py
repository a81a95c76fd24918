"""Explicit rules, shared-knot partitions and decisions that combine models."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.functions import membership, norms
from hazelogic.operators import rules
from hazelogic.operators.infer import Model, probabilities


@dataclass
class Rule:
    """A consequent with, for each feature, the memberships (or term numbers) joined by OR."""

    label: str
    clauses: dict[str, list]


def explicit_rules(model: Model) -> list[Rule]:
    """One rule for each label, from the memberships the model has for it."""
    return [Rule(x, {f: list(model.cells[f, x]) for f in model.features if model.cells.get((f, x))}) for x in model.labels]


def rule_strengths(ruleset: list[Rule], t_norm: str = "probability", t_conorm: str | None = None) -> Column:
    """Array of Gaussian rule strengths in rule order."""
    both = norms.resolve(t_norm, t_norm, t_conorm or t_norm, allow_mixed=True)
    one = lambda r: norms.fold_and([norms.fold_or([membership.gaussian(F.col(f).cast("double"), m, s) for m, s in parts], both[1]) for f, parts in r.clauses.items()], both[0])
    return F.array(*[one(r) for r in ruleset])


def classify_by_rules(strengths: Column, ruleset: list[Rule]) -> Column:
    """The consequent of the strongest rule; the first of ties."""
    return F.element_at(F.array(*[F.lit(r.label) for r in ruleset]), F.array_position(strengths, F.array_max(strengths)).cast("int"))


def augment(model: Model, more: Model) -> Model:
    """All memberships of both models, those of the first before."""
    cells: dict = defaultdict(list)
    for m in (model, more):
        for k, v in m.cells.items():
            cells[k] += v
    return Model(dict(cells))


def convex_product(clauses: dict[str, list[tuple[float, float]]]) -> list[dict[str, tuple[float, float]]]:
    """Every choice of one interval for each feature, from intervals that are apart."""
    names = list(clauses)
    return [dict(zip(names, pick, strict=True)) for pick in itertools.product(*[clauses[f] for f in names])]


def index_runs(terms: list[int]) -> list[list[int]]:
    """Maximal runs of consecutive term numbers."""
    got = sorted(set(terms))
    return [[t for _, t in g] for _, g in itertools.groupby(enumerate(got), key=lambda p: p[1] - p[0])]


def split_contiguous(rule: Rule) -> list[Rule]:
    """A rule for every choice of one run for each feature."""
    runs = {f: index_runs(ts) for f, ts in rule.clauses.items()}
    return [Rule(rule.label, dict(zip(runs, pick, strict=True))) for pick in itertools.product(*runs.values())]


# ------------------------------------------------------------ partitions on shared knots


@dataclass
class Partition:
    """Knots of every feature, and rules over term numbers."""

    knots: dict[str, list[float]]
    ruleset: list[Rule] = field(default_factory=list)


def merge_close(values: list[float], tol: float) -> list[float]:
    """Means of runs of sorted values whose gaps are at most `tol`."""
    runs: list[list[float]] = []
    for v in sorted(values):
        if runs and v - runs[-1][-1] <= tol:
            runs[-1].append(v)
        else:
            runs.append([v])
    return [math.fsum(g) / len(g) for g in runs]


def landmark_knots(landmarks: list[float], lo: float, hi: float, merge: float = 0.05, most: int | None = None) -> list[float]:
    """Merged and thinned landmarks, with the range's ends and a knot just beyond each.

    The shoulders of the outer knots are 0 on the whole observed range.
    """
    span = hi - lo if hi > lo else 1.0
    got = merge_close(landmarks, merge * span)
    if len(got) < 2:
        got = [lo, hi] if hi > lo else [lo, lo + 1.0]
    if most and len(got) > most:
        got = [got[i] for i in sorted({round(k * (len(got) - 1) / max(most - 1, 1)) for k in range(most)})]
    eps = max(span * 1e-6, 1e-9)
    inside = [k for k in got if lo < k < hi]
    return sorted({lo - eps, lo, *inside, hi, hi + eps})


def term_activations(df: DataFrame, label: str, knots: dict[str, list[float]]) -> DataFrame:
    """`feature, label, term, activation`: mean membership of each term for each label, in one shuffle."""
    sums = [F.avg(t).alias(f"{f}\t{i}") for f, k in knots.items() for i, t in enumerate(rules.ruspini_terms(F.col(f).cast("double"), k))]
    wide = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*sums)
    long = wide.unpivot("label", [F.col(f"`{f}\t{i}`") for f, k in knots.items() for i in range(len(k))], "__t", "activation")
    parts = F.split("__t", "\t")
    return long.select(parts[0].alias("feature"), "label", parts[1].cast("int").alias("term"), "activation")


def ruspinize(df: DataFrame, model: Model, label: str, merge: float = 0.05, most: int | None = None, assign: float = 0.5, sigma_knots: float = membership.TRIANGLE_HALF_WIDTH) -> Partition:
    """A shared-knot partition of a Gaussian model, with one rule for each label.

    Landmarks are the means and, inside the observed range, the means moved by
    `sigma_knots` deviations. A rule takes the terms whose mean membership over
    the label's rows is at least `assign` of the best term's.
    """
    ends = df.agg(*[g(F.col(f).cast("double")) for f in model.features for g in (F.min, F.max)]).first()
    knots = {}
    for i, f in enumerate(model.features):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        if lo is None:
            raise ValueError(f"no values of {f}")
        marks = []
        for x in model.labels:
            for m, s in model.cells.get((f, x), []):
                sides = [m - sigma_knots * s, m + sigma_knots * s] if sigma_knots > 0 and s > 1e-6 else []
                marks += [m, *[v for v in sides if lo <= v <= hi]]
        knots[f] = landmark_knots(marks, lo, hi, merge, most)
    got: dict = defaultdict(dict)
    for r in term_activations(df, label, knots).collect():  # one row a feature, label and term
        got[r.label, r.feature][r.term] = r.activation or 0.0
    out = []
    for x in model.labels:
        clauses = {}
        for f in model.features:
            acts = got.get((x, f), {0: 0.0})
            best = max(acts.values())
            clauses[f] = sorted(t for t, a in acts.items() if a >= assign * best) if best > 0 else [min(acts)]
        out.append(Rule(x, clauses))
    return Partition(knots, out)


def complete_gaps(p: Partition, ranges: dict[str, tuple[float, float]], most: float = 0.25) -> Partition:
    """Midpoint knots until no span exceeds a share of the range; rules that use a neighbour take the new term."""
    knots = {f: list(k) for f, k in p.knots.items()}
    out = [Rule(r.label, {f: list(t) for f, t in r.clauses.items()}) for r in p.ruleset]
    for f, (lo, hi) in ranges.items():
        k, limit, i = knots[f], most * ((hi - lo) if hi > lo else 1.0), 0
        while i < len(k) - 1:
            if k[i + 1] - k[i] <= limit:
                i += 1
                continue
            k.insert(i + 1, (k[i] + k[i + 1]) / 2)
            for r in out:
                if f in r.clauses:
                    moved = {t + (t > i) for t in r.clauses[f]}
                    r.clauses[f] = sorted(moved | ({i + 1} if moved & {i, i + 2} else set()))
    return Partition(knots, out)


def to_vector(p: Partition) -> list[float]:
    """Knots of all features in order."""
    return [k for f in p.knots for k in p.knots[f]]


def from_vector(p: Partition, v: list[float]) -> Partition:
    """The partition with other knots, sorted within a feature; rules stay."""
    it = iter(v)
    return Partition({f: sorted(next(it) for _ in k) for f, k in p.knots.items()}, p.ruleset)


def partition_strengths(p: Partition, family: str = "probability") -> Column:
    """Array of rule strengths: OR over a rule's terms, AND over features."""
    terms = {f: rules.ruspini_terms(F.col(f).cast("double"), k) for f, k in p.knots.items()}
    return F.array(*[norms.fold_and([norms.fold_or([terms[f][t] for t in ts], family) for f, ts in r.clauses.items()], family) for r in p.ruleset])


def partition_probabilities(p: Partition, labels: list, family: str = "probability") -> Column:
    """Sums of the strengths of each label's rules over the total; uniform where none fires."""
    s = partition_strengths(p, family)
    sums = [sum((F.get(s, F.lit(i)) for i, r in enumerate(p.ruleset) if r.label == x), F.lit(0.0)) for x in labels]
    return probabilities(F.array(*sums), len(labels))


# ------------------------------------------------------------ decisions that combine models


def soft_vote(members: list[Column], n: int) -> Column:
    """Array of mean probabilities of the members' arrays."""
    return F.array(*[sum((F.get(m, F.lit(i)) for m in members[1:]), F.get(members[0], F.lit(i))) / len(members) for i in range(n)])


def hard_vote(votes: list[Column], labels: list) -> Column:
    """The label of most votes; the first in label order of ties."""
    counts = F.array(*[sum(((v == x).cast("int") for v in votes[1:]), (votes[0] == x).cast("int")) for x in labels])
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(counts, F.array_max(counts)).cast("int"))


def cascade(base: Column, experts: list[tuple[str, str, Column, Column, float, float]]) -> Column:
    """The base label, then experts in order: (from, to, preference, anomaly, threshold, margin).

    An expert moves rows now labelled `from` to `to` where its preference
    exceeds the margin and the row's anomaly is below its threshold; a row once
    out of an expert's region stays as it is.
    """
    for start, to, prefers, anomaly, threshold, margin in experts:
        base = F.when((base == start) & (prefers > margin) & (anomaly < threshold), F.lit(to)).otherwise(base)
    return base


def best_threshold(df: DataFrame, anomaly: Column, gain: Column) -> DataFrame:
    """`threshold, net`: below which anomaly a move gains most rows; 0 where no move helps.

    `gain` is 1 where the move corrects a row, -1 where it spoils one and 0
    else. Sums by distinct anomaly come first, in blocks of 1/256 whose totals
    are added, so the running sum is exact and no task sees all rows.
    """
    from pyspark.sql import Window

    sums = df.select(anomaly.cast("double").alias("a"), gain.cast("long").alias("g")).where("a is not null and g is not null").groupBy("a").agg(F.sum("g").alias("g"))
    cells = sums.withColumn("b", F.least(F.greatest(F.floor(F.col("a") * 256), F.lit(-1)), F.lit(256)))
    base = cells.groupBy("b").agg(F.sum("g").alias("t")).withColumn("before", F.sum("t").over(Window.orderBy("b")) - F.col("t"))  # at most 258 rows
    own = Window.partitionBy("b").orderBy("a")
    run = cells.withColumn("run", F.sum("g").over(own)).join(F.broadcast(base), "b").select("a", (F.col("run") + F.col("before")).alias("net"))
    best = run.agg(F.max(F.struct("net", (-F.col("a")).alias("na"))).alias("m"))
    up = F.col("m.net") > 0
    # just above the last value moved: the test is strict
    return best.select(F.when(up, -F.col("m.na")).otherwise(0.0).alias("threshold"), F.when(up, F.col("m.net")).otherwise(0).cast("long").alias("net"))
