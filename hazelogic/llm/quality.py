"""Quality rules and robust outliers, in DataFrame functions alone.

Base statistics come from array functions over a text's words. A document's
transformed statistics form a vector; for each language and source the minimum
covariance determinant (MCD) is found by concentration steps: take the share
`H` of rows nearest in Mahalanobis distance, re-estimate centre and covariance
from them, repeat while the determinant falls. Steps go on from three robust
starts at once; the one of least determinant goes on to the end. The estimates
are then reweighted once, as is usual: all rows inside a chi-squared bound make
the final ones. Quantiles of distances are read off histograms and moments are
plain sums, so every step is a partial aggregate and a group with a third of
all rows costs no more than others.

A short text measures its statistics coarsely, so to every covariance the mean
sampling variance of its group is added (`NOISE`): it keeps a covariance
regular where most rows are equal, and vanishes for long texts. The cutoff is
the chi-squared quantile of `LEVEL`.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazelogic.llm.common import materialise

_WS, _SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
#: Features, and the variance that a text's length alone gives each.
FEATURES = ("x_len", "x_sym", "x_dup", "x_rep")
NOISE = ("v_len", "v_sym", "v_dup", "v_rep")
#: Median of chi-squared with as many degrees of freedom as features (4).
CHI2_MEDIAN = 3.356694
#: A normal vector is rejected once in 1 / LEVEL.
LEVEL = 1e-4
#: The share of rows the estimates rest on, and the steps all starts take before the best goes on.
H, TRIALS = 0.5, 2
#: Steps end where no group's log-determinant falls by more than this, or after MOST.
LEAST_FALL, MOST = 0.01, 20
#: Rows that a group needs for estimates of its own: five to a feature.
LEAST_ROWS = 20
#: The share of normal rows that makes the reweighted estimates.
INNER = 0.975
#: A group's rows are dealt over one more part for every so many.
ROWS_PER_SALT = 2_000


def chi2_quantile(level: float) -> float:
    """What chi-squared of 4 degrees of freedom passes with probability `level`."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if exp(-mid / 2) * (1 + mid / 2) > level else (lo, mid)
    return hi


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of three words that the array holds twice or more.

    Windows are sorted with their places; equal neighbours mark the repeated
    ones, and the marked places in order give the words they cover.
    """
    n = F.size(words) - (size - 1)
    key = F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(size)])
    ranked = F.sort_array(F.arrays_zip(key.alias("k"), F.sequence(F.lit(1), n).alias("p")))
    return F.when(n > 1, ranked)


def _covered(ranked: Column, size: int = 3) -> Column:
    twice = F.filter(ranked, lambda x, i: F.coalesce(F.get(ranked, i + 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(ranked, i - 1)["k"] == x["k"], F.lit(False)))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` in a struct `row`, and the base statistics beside it.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (of
    lines with a word); all 0 for null and empty texts.
    """
    text = F.col("t")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("flat", F.trim(F.translate(text, _WS, " " * len(_WS))))
    rows = rows.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " +")))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(F.translate(x, _WS, " " * len(_WS)))) > 0))
    rows = rows.withColumn("ranked", repeated_words(F.col("words")))
    rows = rows.withColumn("places", _covered(F.col("ranked")))
    gaps = F.transform("places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - x, F.lit(3))))
    return rows.select(
        "row",
        _n(F.size("words")).alias("n_words"),
        _n(F.length(F.translate(text, _WS, ""))).alias("word_chars"),
        _n(F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).alias("n_symbols"),
        _n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _n(F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).alias("n_repeat_words"),
        _n(F.size("lines")).alias("n_lines"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the transformed statistic vector and its sampling variances.

    Log of the mean word length, and square roots of symbols per character,
    repeated lines and repeated words. The square root of a share of n has
    variance 1 / 4n whatever the share; words repeat by the line, so lines are
    what x_rep counts by too. Word lengths spread by about half their mean, so
    the log of the mean of n has variance 1 / 4n as well.
    """
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x_len": F.log(one("word_chars") / one("n_words")),
        "x_sym": F.sqrt(F.col("n_symbols") / one("word_chars")),
        "x_dup": F.sqrt(F.col("n_dup_lines") / one("n_lines")),
        "x_rep": F.sqrt(F.col("n_repeat_words") / one("n_words")),
        "v_len": 0.25 / one("n_words"),
        "v_sym": 0.25 / one("word_chars"),
        "v_dup": 0.25 / one("n_lines"),
        "v_rep": 0.25 / one("n_lines"),
    })


def quantiles(rows: DataFrame, value: dict[str, Column], shares: tuple[float, ...], width: float, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """For each group and name: the upper edge of the histogram bin each share falls in."""
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor(v / width).alias("bin")) for k, v in value.items()]))
    counts = rows.select(*by, bins.alias("b")).groupBy(*by, "b.name", "b.bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by, "name")
    counts = counts.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    return counts.groupBy(*by, "name").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 1) * width)).alias(f"q{i}") for i, q in enumerate(shares)])


_N = range(len(FEATURES))
_PAIRS = [(i, j) for i in _N for j in range(i + 1)]


def _cholesky(params: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The factor l_i_j (i >= j) of the covariance c_i_j, each a plain column, and log_det."""
    for i, j in _PAIRS:
        left = F.col(f"c_{i}_{j}")
        for k in range(j):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l_{j}_{j}"))
    log_det = sum((F.log(f"l_{i}_{i}") for i in _N[1:]), F.log("l_0_0")) * 2
    return params.select(*keys, *[f"m_{i}" for i in _N], *[f"l_{i}_{j}" for i, j in _PAIRS], log_det.alias("log_det"))


def _met(rows: DataFrame, values: DataFrame, parts: DataFrame) -> DataFrame:
    """Joins the rows per group of `values` to `rows`, a hot group in as many parts as it was salted into."""
    return rows.join(values.join(parts, "g"), ["g", "salt"])


def _z(rows: DataFrame) -> DataFrame:
    """`rows`, which hold their group's estimates, with d2, the squared Mahalanobis distance."""
    for i, x in enumerate(FEATURES):
        z = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            z = z - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in _N[1:]), F.col("z_0") * F.col("z_0")))


def _log_d2() -> Column:
    return F.log1p(F.col("d2"))


def _starts(rows: DataFrame, floors: DataFrame, parts: DataFrame) -> DataFrame:
    """Three estimates (g, s) of each group: medians, with quartile spreads and three kinds of correlation.

    Kind 0 has none; kind 1 that of the hyperbolic tangents of the standardised
    values; kind 2 that of their directions (the spatial sign).
    """
    q = quantiles(rows, {x: F.col(x) for x in FEATURES}, (0.25, 0.5, 0.75), 1 / 256)
    q = q.groupBy("g").agg(*[F.max(F.when(F.col("name") == x, F.struct("q0", "q1", "q2"))).alias(x) for x in FEATURES]).join(floors, "g")
    base = q.select("g", *[F.col(f"{x}.q1").alias(f"m_{i}") for i, x in enumerate(FEATURES)], *[(((F.col(f"{x}.q2") - F.col(f"{x}.q0")) / 1.349) ** 2 + F.col(f"f_{i}")).alias(f"s_{i}") for i, x in enumerate(FEATURES)])
    base = materialise(base, "mcd-base")
    z = [(F.col(x) - F.col(f"m_{i}")) / F.sqrt(f"s_{i}") for i, x in enumerate(FEATURES)]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    kinds = {1: [F.tanh(v) for v in z], 2: [F.when(norm > 0, v / norm).otherwise(0.0) for v in z]}
    seen = _met(rows, base, parts).groupBy("g").agg(*[F.covar_pop(u[i], u[j]).alias(f"r{k}_{i}_{j}") for k, u in kinds.items() for i, j in _PAIRS])
    both = base.join(seen, "g")

    def start(k: int) -> Column:
        cov = []
        for i, j in _PAIRS:
            r = F.lit(1.0 if i == j else 0.0)
            if k and i != j:
                own = F.col(f"r{k}_{i}_{i}") * F.col(f"r{k}_{j}_{j}")
                r = F.when(own > 0, 0.99 * F.col(f"r{k}_{i}_{j}") / F.sqrt(own)).otherwise(0.0)
            cov.append((r * F.sqrt(F.col(f"s_{i}") * F.col(f"s_{j}"))).alias(f"c_{i}_{j}"))
        return F.struct(F.lit(k).alias("s"), *cov)

    spread = both.select("g", *[f"m_{i}" for i in _N], F.explode(F.array(*map(start, (0, 1, 2)))).alias("x")).select("g", *[f"m_{i}" for i in _N], "x.*")
    return _cholesky(spread, ("g", "s"))


def _estimate(rows: DataFrame, floors: DataFrame, factor: float = 1.0) -> DataFrame:
    """Centre and covariance of each (g, s)'s rows, sampling variance added."""
    x = [F.col(f) for f in FEATURES]
    sums = rows.groupBy("g", "s").agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    sums = sums.join(floors, "g")
    return _cholesky(sums.select("g", "s", *[f"m_{i}" for i in _N], *[(F.col(f"c_{i}_{j}") * factor + (F.col(f"f_{i}") if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS]), ("g", "s"))


def _concentrate(rows: DataFrame, params: DataFrame, floors: DataFrame, parts: DataFrame) -> DataFrame:
    """One step of each (g, s): estimates from the share H of its group's rows that is nearest."""
    near = _z(_met(rows, params, parts)).select("g", "salt", "s", "d2", *FEATURES)
    edge = quantiles(near, {"d2": _log_d2()}, (H,), 1 / 512, ("g", "s")).select("g", "s", F.col("q0").alias("edge"))
    inner = near.join(edge.join(parts, "g"), ["g", "salt", "s"]).where(_log_d2() < F.col("edge"))
    return _estimate(inner, floors)


def mcd(rows: DataFrame, floors: DataFrame, parts: DataFrame) -> DataFrame:
    """The estimates of least determinant of each group: g, s (the start it came from), m_i, l_i_j, log_det."""
    params = _starts(rows, floors, parts)
    for _ in range(TRIALS):
        params = materialise(_concentrate(rows, params, floors, parts), "mcd")
    cols = [c for c in params.columns if c != "g"]
    params = materialise(params.groupBy("g").agg(F.min_by(F.struct(*cols), F.struct("log_det", "s")).alias("x")).select("g", "x.*"), "mcd")
    for _ in range(MOST):
        step = _concentrate(rows, params, floors, parts).select("g", F.struct(*cols).alias("y"))
        both = params.select("g", F.struct(*cols).alias("x")).join(step, "g", "left")
        falls = F.coalesce(F.col("y.log_det") < F.col("x.log_det"), F.lit(False))
        both = materialise(both.select("g", F.when(falls, F.col("y")).otherwise(F.col("x")).alias("z"), F.when(falls, F.col("x.log_det") - F.col("y.log_det")).otherwise(0.0).alias("fall")), "mcd")
        params = both.select("g", "z.*")
        if (both.agg(F.max("fall")).first()[0] or 0.0) <= LEAST_FALL:
            break
    return params


def _keys(rows: DataFrame, lang: Column, source: Column) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is a name of its own
    return rows.withColumns({"lg": name(lang), "sc": name(source)})


def _groups(rows: DataFrame) -> DataFrame:
    """`g` for each (lg, sc): both, or the language's rest, or that of all, where rows are too few."""
    fine = rows.groupBy("lg", "sc").agg(F.count("*").alias("n"))
    rest = fine.where(F.col("n") < LEAST_ROWS).groupBy("lg").agg(F.sum("n").alias("rest"))
    return fine.join(rest, "lg", "left").select(
        "lg", "sc", "n", F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\x01", F.lit("2"), "lg", "sc")).when(F.col("rest") >= LEAST_ROWS, F.concat_ws("\x01", F.lit("1"), "lg")).otherwise("0").alias("g"),
    )


def _scale(rows: DataFrame, params: DataFrame, parts: DataFrame) -> DataFrame:
    """g and scale: a group's median squared distance as a multiple of chi-squared's, at least 1."""
    q = quantiles(_z(_met(rows, params, parts)), {"d2": _log_d2()}, (0.5,), 1 / 512)
    return q.select("g", F.greatest(F.expm1("q0") / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))


def fit(stats: DataFrame) -> DataFrame:
    """The reweighted MCD estimates of each (lg, sc): centre, Cholesky factor and scale.

    `stats` has lg, sc, base_failed, the features and their variances; rows
    that fail a base rule take no part. One row per language and source,
    written in the shared folder.
    """
    names = _groups(stats.where(~F.col("base_failed")))
    salts = names.groupBy("g").agg(F.ceil(F.sum("n") / ROWS_PER_SALT).alias("salts"))
    names = materialise(names.join(salts, "g"), "quality-groups")
    parts = materialise(names.select("g", "salts").distinct().select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), "quality-parts")
    rows = stats.where(~F.col("base_failed")).join(names, ["lg", "sc"])
    rows = materialise(rows.select("g", F.pmod(F.monotonically_increasing_id(), "salts").alias("salt"), *FEATURES, *NOISE), "quality-rows")
    floors = materialise(rows.groupBy("g").agg(*[F.avg(v).alias(f"f_{i}") for i, v in enumerate(NOISE)]), "quality-noise")
    rows = rows.drop(*NOISE)
    raw = mcd(rows, floors, parts)
    near = _z(_met(rows, materialise(raw.join(_scale(rows, raw, parts), "g"), "mcd"), parts))
    bound = chi2_quantile(1 - INNER)
    factor = INNER / (1 - exp(-bound / 2) * (1 + bound / 2 + bound * bound / 8))  # what the cut takes from a normal covariance
    final = materialise(_estimate(near.where(F.col("d2") <= bound * F.col("scale")), floors, factor), "mcd")
    return materialise(names.join(final, "g").join(_scale(rows, final, parts), "g").drop("g", "s", "n", "salts", "log_det"), "quality-model")


def apply(stats: DataFrame, model: DataFrame, level: float = LEVEL) -> DataFrame:
    """Adds d2 and kept to rows with lg, sc, base_failed and the features.

    The model is small unless sources are very many: Spark checks its size and
    broadcasts it, or joins by language and source and splits the hot ones.
    """
    model = model.withColumnsRenamed({"lg": "g", "sc": "h"})
    rows = stats.withColumns({"g": F.col("lg"), "h": F.col("sc")}).join(model, ["g", "h"], "left").drop("g", "h")
    rows = _z(rows).withColumn("d2", F.col("d2") / F.col("scale"))
    return rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("d2") <= chi2_quantile(level), F.lit(True))))


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _stats(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    stats = with_features(base_stats(docs, text_col))
    return _keys(stats, F.col(f"row.`{lang_col}`"), F.col(f"row.`{source_col}`"))


def judge(docs: DataFrame, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, d2 and kept for every row.

    kept is false where a base rule fails, else whether the squared distance,
    scaled so that its group's median is at most that of chi-squared, stays
    within chi-squared's quantile of `level`. Estimates use every row without
    a base failure; a group of fewer than `LEAST_ROWS` such rows takes part in
    its language's rest, and that, where still too few, in one rest of all.
    Null languages and sources are groups of their own. Null and empty texts
    fail a base rule; repeated rows count as often as they stand; other
    columns are not read; an empty table gives an empty result.
    """
    slim = _stats(docs.select(*dict.fromkeys([id_col, text_col, lang_col, source_col])), text_col, lang_col, source_col)
    slim = materialise(slim.select(F.col(f"row.`{id_col}`").alias("doc_id"), "lg", "sc", *OWN, *FEATURES, *NOISE), "quality")
    return apply(slim, fit(slim), level).select("doc_id", *OWN, "d2", "kept")


def keep(docs: DataFrame, level: float = LEVEL, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that `judge` keeps, with all their columns, of any names.

    Texts are analysed once: rows are written with their statistics, and
    neither estimates nor verdicts move a text.
    """
    both = _stats(docs, text_col, lang_col, source_col).select("row", "lg", "sc", "base_failed", *FEATURES, *NOISE)
    both = materialise(both, "quality")
    return apply(both, fit(both), level).where("kept").select("row.*")
