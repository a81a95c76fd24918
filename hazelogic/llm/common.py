"""Shared helpers: table access, shared folders, materialised intermediate tables."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at a time inside a Python worker; bounds the
#: objects alive at once, never what is read.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder, pruned to `cols` where any are named."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where neither that setting nor a checkpoint folder exists, and the
    master is local (tests), a temporary folder is made and set. On a cluster
    a missing setting raises: executors would write where nobody reads.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="hazelogic-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/hazelogic/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


#: Intermediate tables, by the stage that wrote them (none: an operator called by itself); only its own result reads them.
_scratch: list[tuple[str | None, str]] = []
_stage: str | None = None
#: Tables written between collections of garbage, which lets Spark drop the shuffles and broadcasts of earlier steps.
EACH = 5
_written = 0


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts lineage and survives lost executors; unlike `checkpoint()` it
    computes the plan one time only. The table goes when the driver ends, or,
    unless it is to `keep`, with the stage that it belongs to (see `begin`).
    """
    global _written
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    if not keep:
        _scratch.append((_stage, path))
    _written += 1
    if _written % EACH == 0:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def begin(spark: SparkSession, stage: str) -> None:
    """Deletes the intermediate tables of other stages, whose results must have been written by now.

    Tables of the same stage stay, and so do those of operators called before
    any stage.
    """
    global _stage
    _stage = stage
    for entry in [e for e in _scratch if e[0] not in (None, stage)]:
        _scratch.remove(entry)
        _delete(spark, entry[1])


def filesystem(uri: str):
    """A file system and a path in it, for file:, hdfs:, s3: and the like."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


#: Rows of a partition share the upper bits of `monotonically_increasing_id`.
PART_BITS = 33


def chosen(rows: DataFrame, keys: DataFrame, what: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Those of `rows` whose `key`, a `monotonically_increasing_id`, is among the distinct `keys.key`.

    The rows, which may hold long texts, are not shuffled: keys are written by
    the partition that made them, and a task reads the lists of the partitions
    its rows come from, each as long as that partition at most. `then` takes
    the batches of chosen rows on to batches of `schema`, in the same worker.
    """
    path = new_path(rows.sparkSession, what)
    by_part = keys.select("key", F.call_function("shiftright", F.col("key"), F.lit(PART_BITS)).alias("part"))
    by_part.repartition("part").write.partitionBy("part").parquet(path)
    _scratch.append((_stage, path))
    at = rows.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        held: dict[int, np.ndarray] = {}
        for b in batches:
            key = b.column(at).to_numpy()
            keep = np.zeros(len(key), bool)
            for part in np.unique(key >> PART_BITS):
                if part not in held:
                    held.clear()
                    held[part] = _keys(fs, f"{base}/part={part}")
                own = key >> PART_BITS == part
                keep[own] = np.isin(key[own], held[part])
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema) if then is None else rows.mapInArrow(lambda batches: then(run(batches)), schema)


def _keys(fs, folder: str) -> np.ndarray:
    from pyarrow import fs as arrow_fs
    from pyarrow import parquet

    files = [f.path for f in fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    out = []
    for f in files:
        with fs.open_input_file(f) as file:
            out.append(parquet.ParquetFile(file).read(columns=["key"]).column("key").to_numpy())
    return np.concatenate([np.zeros(0, np.int64), *out])


def as_row(docs: DataFrame, names: tuple[str, ...] | None = None) -> Column:
    """The columns `names` of `docs` (all by default) as one struct `row`: no name in it can clash."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in (docs.columns if names is None else names)]).alias("row")


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` characters together, at least one row."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def ascii_lower(text: str | None) -> str:
    """`text` with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""
