"""The corpus pipeline: language ID, quality rules, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs. All but the last return the
columns of documents. As the stage before has been written by then, a stage
begins by deleting the intermediate tables of those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazelogic.llm import decontam, langid, mixing, quality, simhash
from hazelogic.llm.common import begin, chosen, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Languages less likely than this are not trusted.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with it as their `lang`.

    Documents without a letter (null and empty texts too) go, and those whose
    likeliest language is less likely than `LEAST_POSTERIOR`. Null ids and
    repeated rows stay as they stand; extra columns are left out; an empty
    table gives an empty result.
    """
    begin(spark, "language")
    found = langid.identify(docs, langid.train(docs), carry=COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_POSTERIOR))
    return kept.select("row.*", "lang_pred").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail a base rule and go; null languages and sources
    are groups of their own; repeated rows are judged alike; extra columns are
    left out; an empty table gives an empty result.
    """
    begin(spark, "quality_rules")
    return quality.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest id, null ids last.

    Five-word shingles at a similarity of 0.8, which takes 256 bits: the 4 of
    64 bits of op8 find next to none of the copies at that similarity. Groups
    are of rows, so rows of null or repeated ids count like any other and
    exact repeats collapse to one; all texts without a word are one group. Of
    rows that repeat the smallest id the one of the least hash of its other
    columns stays. The least is a partial aggregate. Extra columns are left
    out; an empty table gives an empty result.
    """
    begin(spark, "near_duplicates")
    rows, groups = simhash.near_copies(docs.select(*COLUMNS))
    place = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64(*[F.col(f"row.{c}") for c in COLUMNS[1:]]), F.col("key")).alias("place")
    first = rows.select("key", place).join(groups, "key").groupBy("component").agg(F.min("place").alias("place")).select("place.key")
    return chosen(rows, first, "kept-keys").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have no window and stay, and so do null ids; repeated
    rows are judged alike; extra columns are left out; an empty table, or one
    without items, changes nothing.
    """
    begin(spark, "decontaminate")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.find_contamination(docs, items, carry=COLUMNS).where("n_hit = 0").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy taken, with its number in `copy`.

    Beside the columns of documents it has size (words), source_size, target
    and copies. Null and empty texts have size 0 and are taken like others of
    their source; a null source is one of its own; null ids and repeated rows
    are each taken for themselves; extra columns are left out; an empty table
    gives an empty result.
    """
    begin(spark, "mix")
    sized = docs.select(*COLUMNS, mixing.word_count("text").alias("size"))
    return mixing.emit(mixing.plan_mix(sized)).select("row.*", "source_size", "target", "copies", "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: Language ID and robust outliers have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
