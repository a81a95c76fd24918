"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / source size` times. Documents
stand in a fixed order inside their source; the prefix sum of expected copies,
moved by one random offset, crosses integers, and each crossing emits the
document once. The order goes by size, so what a source takes differs from its
target by about one document's words.

Ranks are found without gathering a source: counts by (source, size class),
then by (source, class, hash bin), then by id inside a bin, then row numbers
inside the parts that rows of one id and size are dealt into; there are about as
many bins as rows in a bin. A source, a size, an id or a group of copies that
holds a third of all rows is dealt over all tasks.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazelogic.llm.common import as_row, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: The random offset is a multiple of this part of 1, so sums with whole numbers are exact.
OFFSET_STEPS = 1 << 20


def word_count(text: str | F.Column) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: F.Column) -> F.Column:
    """Never null, and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _hash32(*cols: F.Column) -> F.Column:
    """32 bits of a digest that other engines also have."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Adds rank, weight and target to one row per source (`key`, `source_size`).

    The targets share the sum of all sizes by weight; one above `cap` times its
    source's size is set to that and the excess reshared among the others by
    weight, until none is above. The table stays distributed: only two sums go
    to the driver in each round, and a round fixes at least one source.
    """
    spark = sizes.sparkSession
    ranked = sizes.orderBy("key").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    pairs = spark.createDataFrame(ranked, "key string, source_size long, rank long")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    src = materialise(pairs.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap))), "sources")
    total = float(src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, before = 0.0, -1.0
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        fixed, left = src.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight"))), F.lit(0.0))).first()
        level = (total - fixed) / left if left else level
        if level <= before or not left:
            break
        before = level
    return src.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """row (a struct of all columns of `docs`, of any names), source_size, target and copies.

    copies is how often the mix takes the row, at most `ceil(cap)`. Rows of
    null source are a source of their own, in last place; rows of size 0 count
    as documents but add nothing; repeated rows are taken each for itself, and
    swapping equal rows changes nothing. Ids of any type and null ids are
    ordered by a digest of their text; rows of one id, source and size by a
    hash of the whole row, which also deals them out, so an id that very many
    rows share is numbered in parts. A source of size 0 takes none of its rows.
    The result depends on the rows alone, not on their partitions. An empty
    table gives an empty result.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    bits = F.length(F.bin(size))
    keyed = docs.select(
        _source_key(F.col(source_col)).alias("key"),
        size.alias("n"),
        F.when(size < 32, size).otherwise((bits - 5) * 16 + F.call_function("shiftright", size, bits - 5)).alias("class"),
        _hash32(F.col(id_col).cast("string")).alias("h"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mark"),
        as_row(docs),
    )
    narrow = materialise(keyed.groupBy("key", "class", "h", "id", "n", "mark").agg(F.count("*").alias("m")), "mix")
    rows = narrow.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bins = max(1, ceil(sqrt(rows)))
    a_bin = F.floor(F.col("h") * F.lit(bins) / F.lit(float(1 << 32))).alias("bin")
    part = F.pmod(F.col("mark"), F.lit(bins)).alias("part")
    ties = narrow.groupBy("key", "class", a_bin, "h", "id", "n", part).agg(F.sum("m").alias("m"))
    cells = ties.groupBy("key", "class", "bin").agg(F.sum("m").alias("m"))
    inside = Window.partitionBy("key", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0))).drop("m")
    classes = narrow.groupBy("key", "class").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("n")).alias("n"))
    below = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    src = source_targets(classes.groupBy("key").agg(F.sum("n").alias("source_size")), weights, cap)
    start = classes.select("key", "class", F.coalesce(F.sum("m").over(below), F.lit(0)).alias("start")).join(src, "key")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key"))), 1, 5), 16, 10).cast("double") / OFFSET_STEPS
    tied = Window.partitionBy("key", "class", "bin").orderBy("h", "id", "n", "part").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("above", F.coalesce(F.sum("m").over(tied), F.lit(0)))
    given = ties.join(cells, ["key", "class", "bin"]).join(start, ["key", "class"]).select(
        "key", "class", "bin", "h", "id", F.col("n").alias("n"), "part", "source_size", "target", (F.col("start") + F.col("before") + F.col("above")).alias("first"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("u"),
    )
    own = ["key", "class", "bin", "h", "id", "n", "part"]
    placed = keyed.withColumns({"bin": a_bin, "part": part}).withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy("mark"))).join(given, own)
    rank = F.col("first") + F.col("place")
    copies = F.floor(F.col("u") + rank * F.col("rate")) - F.floor(F.col("u") + (rank - 1) * F.col("rate"))
    return placed.select("row", "source_size", "target", copies.cast("long").alias("copies"))


def emit(planned: DataFrame) -> DataFrame:
    """One row for each copy a plan takes, numbered from 0 in `copy`."""
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
