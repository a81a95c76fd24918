"""Token counts from distinct pre-tokens.

A piece of the vocabulary holds the space mark only at its front, so no merge
crosses from a word into the spaces after it: a text's pieces are those of its
pre-tokens (a run of spaces with the word after it) taken one by one. The
pieces of every distinct pre-token of the corpus are counted once and joined to
the documents' pre-token frequencies; the ids of a text are never materialised.

The join has two halves. Pre-tokens that are frequent in the corpus, as many as
fit `TABLE_BYTES`, are counted first and broadcast, and documents look them up
where they stand. All others travel with their document's key and frequency to
the task of their pre-token, which counts its pieces once for all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import chunks, materialise

_PRE_TOKEN = re.compile(" +[^ ]*")
_CUT = re.compile("(?<=[^ ]) ")
_MARK = "▁"
#: Bytes of the broadcast table of frequent pre-tokens, `ENTRY` for each beside its own.
TABLE_BYTES, ENTRY = 32 << 20, 64
#: Times a pre-token must occur in a task to be a candidate for that table (any other joins by shuffle).
LEAST = 2
#: Distinct pre-tokens that a task gathers before it passes them on; bounds a worker's memory only.
MEMO = 400_000
#: Characters of one text split at a time.
STEP = 1_000_000


@lru_cache(maxsize=4)
def _processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def splits_at_spaces(model_file: str) -> bool:
    """Whether no piece of the model crosses from a word into a space."""
    p = _processor(model_file)
    return not any(_MARK in p.id_to_piece(i).lstrip(_MARK) for i in range(p.vocab_size()))


def pre_tokens(text: str) -> Counter:
    """Frequencies of the pre-tokens of a text, each with its leading space."""
    if not text:
        return Counter()
    text, found, at = " " + text.replace(_MARK, " "), Counter(), 0
    while at < len(text):
        cut = _CUT.search(text, at + STEP) if at + STEP < len(text) else None
        end = cut.start() if cut else len(text)
        found.update(_PRE_TOKEN.findall(text, at, end))
        at = end
    return found


def pieces(model_file: str, tokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token."""
    encode, out = _processor(model_file).encode, []
    # the library puts one space before what it gets: that is the pre-token's own
    for at in range(0, len(tokens), 50_000):
        out += map(len, encode([p[1:] for p in tokens[at : at + 50_000]], num_threads=1))
    return [1 if t == " " else n for t, n in zip(tokens, out, strict=True)]


def frequent(docs: DataFrame, model_file: str, text_col: str = "text", table_bytes: int = TABLE_BYTES) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, all above a count under which they would not fit `table_bytes`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                own.update(pre_tokens(t))
                if len(own) > MEMO:
                    yield _often(own)
                    own = Counter()
        yield _often(own)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces(model_file, b.column(0).to_pylist()), pa.int32())], names=["token", "pieces"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pre-tokens")
    level = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.sum(F.octet_length("token") + ENTRY).alias("bytes")).collect()  # at most 63 rows
    held, least = 0, 64
    for r in sorted(sizes, key=lambda r: -r.level):
        held += r.bytes
        if held > table_bytes:
            break
        least = r.level
    got = counts.where(level >= least).select("token").mapInArrow(encode, "token string, pieces int").toArrow()  # of table_bytes at most
    return dict(zip(got.column("token").to_pylist(), got.column("pieces").to_pylist(), strict=True))


def _often(own: Counter) -> pa.RecordBatch:
    kept = {t: n for t, n in own.items() if n >= LEAST}
    return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["token", "n"])


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for every row of `docs`.

    `model_file` is a sentencepiece BPE model on the executors; one whose
    pieces hold spaces inside is refused. A null or empty text has 0 bytes and
    0 tokens. Null and repeated ids are kept as they are, of any type; other
    columns, also of clashing names, are not read. An empty table gives an
    empty result.
    """
    if not splits_at_spaces(model_file):
        raise ValueError("pieces of this model cross spaces: pre-tokens can't be counted one by one")
    given = docs.sparkSession.sparkContext.broadcast(frequent(docs, model_file, text_col, table_bytes))  # of table_bytes at most

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in chunks(texts):
                known, tokens, times, upto = [], [], [], [0]
                for t in texts[lo:hi]:
                    sum_ = 0
                    for p, n in pre_tokens(t).items():
                        if (k := table.get(p)) is not None:
                            sum_ += k * n
                        else:
                            tokens.append(p)
                            times.append(n)
                    known.append(sum_)
                    upto.append(len(tokens))
                rest = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], names=["token", "n"]))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(known, pa.int64()), rest], names=["row", "doc_id", "n_bytes", "known", "rest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0  # rows come sorted by pre-token
        for b in batches:
            token, n = b.column(0), b.column(2).to_numpy()
            new = token.dictionary_encode()
            names, at = new.dictionary.to_pylist(), new.indices.to_numpy()
            todo = [t for t in names if t != last]
            found = dict(zip(todo, pieces(model_file, todo), strict=True))
            if last is not None:
                found.setdefault(last, count)
            counts = np.array([found[t] for t in names], np.int64)
            if names:
                last = names[at[-1]]
                count = found[last]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(counts[at] * n)], names=["row", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    looked = materialise(rows.mapInArrow(look_up, f"row long, doc_id {kind}, n_bytes long, known long, rest array<struct<token:string,n:bigint>>"), "tokens-known")
    rest = looked.select("row", F.explode("rest").alias("x")).select("x.token", "row", "x.n")
    sums = rest.repartition("token").sortWithinPartitions("token").mapInArrow(encode, "row long, n long").groupBy("row").agg(F.sum("n").alias("more"))
    both = looked.drop("rest").join(sums, "row", "left")
    return both.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
