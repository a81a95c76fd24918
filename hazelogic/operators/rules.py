"""Rule-base operators over the small table of memberships, and soft-tree splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RTOL, ATOL = 1e-2, 1e-3


def close(a: Column, b: Column) -> Column:
    """Within tolerance of the second; NaN never is."""
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= ATOL + RTOL * F.abs(b)))


def dedup_memberships(mf: DataFrame, label: str) -> DataFrame:
    """Drops a membership that is near an earlier one of its feature and label (k: order)."""
    a, b = mf.alias("a"), mf.alias("b")
    same = (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{label}") == F.col(f"b.{label}")) & (F.col("b.k") < F.col("a.k"))
    return a.join(b, same & close(F.col("b.mu"), F.col("a.mu")) & close(F.col("b.sigma"), F.col("a.sigma")), "left_anti")


def convex_clauses(mf: DataFrame, label: str, k: float = 3.0) -> DataFrame:
    """Merges overlapping or touching supports of a feature and label into intervals."""
    order = Window.partitionBy("feature", label).orderBy("lo", "hi")
    iv = mf.select("feature", label, (F.col("mu") - k * F.col("sigma")).alias("lo"), (F.col("mu") + k * F.col("sigma")).alias("hi"))
    new = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = iv.withColumn("clause", F.sum(new.cast("int")).over(order))
    return runs.groupBy("feature", label, "clause").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("members"))


def ruspini_terms(x: Column, knots: list[float]) -> list[Column]:
    """Triangles on shared knots with shoulders at both ends; they sum to 1 everywhere."""
    out = []
    for i, k in enumerate(knots):
        left = F.lit(1.0) if i == 0 else F.greatest((x - knots[i - 1]) / (k - knots[i - 1]), F.lit(0.0))
        right = F.lit(1.0) if i == len(knots) - 1 else F.greatest((knots[i + 1] - x) / (knots[i + 1] - k), F.lit(0.0))
        out.append(F.when(x <= k, left).otherwise(right))
    return out


def term_tuples(df: DataFrame, label: str, terms: dict[str, list[Column]], least_share: float = 0.0) -> DataFrame:
    """Counts of the winning terms of all features together, by label."""
    win = [F.array_position(F.array(*ts), F.array_max(F.array(*ts))).cast("int").alias(f"t_{f}") for f, ts in terms.items()]
    counts = df.select(label, *win).groupBy(label, *[f"t_{f}" for f in terms]).agg(F.count("*").alias("n"))
    total = Window.partitionBy(label)
    return counts.where(F.col("n") >= F.lit(1)).withColumn("all", F.sum("n").over(total)).where(F.col("n") >= F.ceil(F.col("all") * least_share)).drop("all")


def joint_clusters(tuples: DataFrame, label: str) -> dict:
    """For each label the groups of winning-term tuples that touch: neighbours differ by at most one in every term.

    `tuples` is a result of `term_tuples` with a least share, so its rows are
    bounded by labels over that share; they are grouped on the driver.
    """
    names = [c for c in tuples.columns if c.startswith("t_")]
    left: dict = {}
    for r in tuples.collect():
        left.setdefault(r[label], set()).add(tuple(r[c] for c in names))
    out: dict = {}
    for x, rest in left.items():
        out[x] = []
        while rest:
            todo = [min(rest)]
            rest.discard(todo[0])
            group = set(todo)
            while todo:
                t = todo.pop()
                near = {u for u in rest if max((abs(a - b) for a, b in zip(t, u, strict=True)), default=0) <= 1}
                rest -= near
                group |= near
                todo += near
            out[x].append(sorted(group))
    return out


def model_report(mf: DataFrame, label: str) -> DataFrame:
    """One row: features, labels, memberships, and the rules that a full grid of them would make."""
    cells = mf.groupBy("feature").agg(F.count("*").alias("n"))
    one = cells.agg(F.count("*").alias("features"), F.sum("n").alias("memberships"), F.product("n").cast("long").alias("grid_rules"))
    return one.join(mf.agg(F.countDistinct(label).alias("labels"))).select("features", "labels", "memberships", "grid_rules")  # one row each


def dedup_model(cells: dict[tuple[str, str], list]) -> tuple[dict[tuple[str, str], list], dict[tuple, tuple]]:
    """Drops shapes near an earlier one of the same feature, whatever its label; and what each maps to.

    Cells are taken in order of label; a dropped shape maps to the last earlier
    one that it is near, followed to a shape that stays.
    """
    target: dict[tuple, tuple] = {}
    for f in sorted({k[0] for k in cells}):
        order = [(k, i, p) for k in sorted(cells) if k[0] == f for i, p in enumerate(cells[k])]
        for n, (k, i, p) in enumerate(order):
            match = next(((*q[0], q[1]) for q in reversed(order[:n]) if q[2].near(p)), None)
            target[(*k, i)] = target.get(match, match) if match else (*k, i)
    kept = {k: [p for i, p in enumerate(v) if target[(*k, i)] == (*k, i)] for k, v in cells.items()}
    return kept, target


def rule_text(mf: DataFrame, label: str, digits: int = 3) -> DataFrame:
    """One IF/THEN line per label."""
    part = F.format_string(f"%s is N(%.{digits}f, %.{digits}f)", "feature", "mu", "sigma")
    own = mf.groupBy(label).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # one row a membership
    return own.select(label, F.concat(F.lit("IF "), F.array_join("parts", " AND "), F.lit(" THEN "), F.col(label)).alias("rule"))


def variance_reduction(df: DataFrame, target: str, terms: list[Column]) -> DataFrame:
    """Share of the target's variance that a soft split removes."""
    y = F.col(target)
    sums = [F.struct(F.sum(t).alias("w"), F.sum(t * y).alias("s"), F.sum(t * y * y).alias("q")) for t in terms]
    one = df.agg(F.var_pop(target).alias("v"), F.count(target).alias("n"), F.array(*sums).alias("t"))
    within = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.when(x["w"] > 0, x["q"] - x["s"] * x["s"] / x["w"]).otherwise(0.0))
    weight = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["w"])
    return one.select(F.when(F.col("v") > 0, (F.col("v") - within / weight) / F.col("v")).otherwise(0.0).alias("gain"))


def information_gain(df: DataFrame, label: str, terms: list[Column]) -> DataFrame:
    """Base-2 entropy of the labels less that of the soft children."""
    plog = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    mass = df.groupBy(label).agg(F.count("*").alias("c"), *[F.sum(t).alias(f"w{i}") for i, t in enumerate(terms)])
    all_ = Window.partitionBy(F.lit(0))  # one row a label
    shares = mass.select(F.col("c") / F.sum("c").over(all_), *[F.col(f"w{i}") / F.sum(f"w{i}").over(all_) for i in range(len(terms))], *[F.sum(f"w{i}").over(all_) for i in range(len(terms))]).toDF("p", *[f"p{i}" for i in range(len(terms))], *[f"m{i}" for i in range(len(terms))])
    total = sum((F.max(f"m{i}") for i in range(1, len(terms))), F.max("m0"))
    child = sum((F.max(f"m{i}") * F.sum(plog(F.col(f"p{i}"))) for i in range(1, len(terms))), F.max("m0") * F.sum(plog(F.col("p0"))))
    return shares.agg((F.sum(plog(F.col("p"))) - child / total).alias("gain"))
