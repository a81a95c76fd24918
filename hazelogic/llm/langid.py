"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in the tasks and sums them by language and
bucket; the log-probability matrix (languages x buckets, a fixed bound) is
broadcast. Scoring turns a batch of texts into one array of code points, hashes
all n-grams at once, gathers their rows of the matrix and sums them by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import as_row, chunks, materialise

#: log2 of the number of buckets, and the orders of the n-grams.
BITS, ORDERS = 16, (1, 2, 3)
#: Languages in one broadcast matrix (16 MB of float32); more languages take several, one after another.
BLOCK = 64
#: Sampled documents that one task counts.
PER_TASK = 1_000
#: Documents of a language that training takes about, chosen by a hash of the id.
PER_LANG = 4_000
UND = "und"
_SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the row and the bucket of every n-gram, rows ascending.

    Runs of other characters than letters count as one space, and so do a
    text's ends; n-grams of spaces alone can't occur.
    """
    low = [f" {t.lower()} " if t else " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    row = np.repeat(np.arange(len(low), dtype=np.int32), sizes)[keep]
    code = np.where(letter, code, _SPACE)[keep]
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(code):
            return
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(0x9E3779B1)
        if n not in ORDERS:
            continue
        same = row[: len(h)] == row[n - 1 :]
        if n == 1:
            same &= code != _SPACE
        x = h[same] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        yield row[: len(h)][same], x >> np.uint32(32 - BITS)


def joint(log_p: np.ndarray, prior: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log joint probability of each text and language, and the n-grams of each text."""
    total, count = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    for row, bucket in ngrams(texts):
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for k in range(len(log_p)):
            total[row[first], k] += np.add.reduceat(log_p[k][bucket], first, dtype=np.float64)
        count += np.bincount(row, minlength=len(texts))
    return total, count


class Model:
    """Languages in order, their log priors, and blocks of their log-probabilities by bucket."""

    def __init__(self, langs: list[str], blocks: list[np.ndarray], prior: np.ndarray):
        self.langs, self.blocks, self.prior = langs, blocks, prior

    def parts(self) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Names, matrix and priors of each block."""
        at = np.cumsum([0, *map(len, self.blocks)])
        return [(self.langs[lo : lo + len(m)], m, self.prior[lo : lo + len(m)]) for lo, m in zip(at, self.blocks, strict=False)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its posterior; `und` and 0 where no letter stands."""
        best = [None] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        for part in self.parts():
            best = _better(part, texts, *best)
        return _verdict(*best)


def _better(part, texts: list[str | None], lang: list, top: np.ndarray, mass: np.ndarray):
    """Goes on from the best language, its log joint probability and the log of the sum of all."""
    names, log_p, prior = part
    total, count = joint(log_p, prior, texts)
    seen = count > 0
    own = total.argmax(axis=1)
    high = total[np.arange(len(texts)), own]
    lang = [names[k] if s and h > t else x for x, k, s, h, t in zip(lang, own, seen, high, top, strict=True)]
    mass = np.where(seen, np.logaddexp(mass, high + np.log(np.exp(total - high[:, None]).sum(axis=1))), mass)
    return lang, np.where(seen, np.maximum(top, high), top), mass


def _verdict(lang: list, top: np.ndarray, mass: np.ndarray) -> tuple[list[str], list[float]]:
    return [UND if x is None else x for x in lang], [0.0 if x is None else min(1.0, float(np.exp(t - m))) for x, t, m in zip(lang, top, mass, strict=True)]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training never sees: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows with a language that aren't held out.

    Class shares come from all those rows, n-gram counts from about `per_lang`
    documents of each language with their whole texts; those few are dealt out
    evenly, so the scan keeps its own tasks. Rows of null text or language
    teach nothing; repeated rows count as often as they stand; an empty table
    gives a model that knows no language. The driver gets a row per language
    and, a block of languages at a time, their counts by bucket.
    """
    rows = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    shares = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = [r.lang for r in shares]
    if not langs:
        return Model([], [], np.zeros(0))
    spark = docs.sparkSession
    # from Arrow it is a local relation, whose size Spark knows
    part = spark.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "place": pa.array(range(len(langs)), pa.int32()), "part": [min(1.0, per_lang / r["count"]) for r in shares]}))
    sample = rows.join(part, "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.col("part") * 1_000_000)
    taken = sum(min(r["count"], per_lang) for r in shares)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0
        for b in batches:
            place, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                for row, bucket in ngrams(texts[lo:hi]):
                    own.append(np.unique(place[lo:hi][row].astype(np.int64) << BITS | bucket, return_counts=True))
                    held += len(own[-1][0])
                if held > 2_000_000:
                    own = [_summed(own)]
                    held = len(own[0][0])
                    if held > 1_000_000:
                        yield _cells(own.pop())
                        held = 0
        if own:
            yield _cells(_summed(own))

    dealt = sample.select("place", "text").repartition(max(1, -(-taken // PER_TASK)))
    sums = dealt.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "ngrams")
    blocks = []
    for lo in range(0, len(langs), BLOCK):
        got = sums.where((F.col("at") >= lo << BITS) & (F.col("at") < (lo + BLOCK) << BITS)).toArrow()
        counts = np.zeros(min(BLOCK, len(langs) - lo) << BITS)
        counts[got.column("at").to_numpy() - (lo << BITS)] = got.column("n").to_numpy()
        counts = counts.reshape(-1, 1 << BITS) + alpha
        blocks.append(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    total = np.array([r["count"] for r in shares], float)
    return Model(langs, blocks, np.log(total / total.sum()))


def _summed(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, where = np.unique(np.concatenate([a for a, _ in own]), return_inverse=True)
    return at, np.bincount(where, np.concatenate([n for _, n in own]), len(at)).astype(np.int64)


def _cells(own: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64())], names=["at", "n"])


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns `carry`, of any names), lang_pred and score, its posterior.

    Null texts and texts without a letter are `und` with score 0, and so is
    everything where nothing was learned. Whole texts are read. Of languages
    equally likely the first in order wins. Repeated rows are each returned;
    an empty table gives an empty result. A text passes the matrices of its
    model's blocks one after another; one holds at most `BLOCK` languages.
    """
    sc = docs.sparkSession.sparkContext
    given = [sc.broadcast(p) for p in model.parts()]
    names, kind = ("row", "text", "lang", "top", "mass"), f"row {docs.select(as_row(docs, carry)).schema['row'].dataType.simpleString()}"
    rows = docs.select(as_row(docs, carry), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(-float("inf")).alias("top"), F.lit(-float("inf")).alias("mass"))
    for k, part in enumerate(given or [None]):
        last = k >= len(given) - 1

        def run(batches: Iterator[pa.RecordBatch], part=part, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, lang, top, mass = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy()
                out = [[], [], []]
                for lo, hi in chunks(texts, 500_000):
                    got = lang[lo:hi], top[lo:hi], mass[lo:hi]
                    for x, y in zip(out, got if part is None else _better(part.value, texts[lo:hi], *got), strict=True):
                        x.extend(y)
                lang, top, mass = out[0], np.array(out[1], float), np.array(out[2], float)
                if last:
                    lang, score = _verdict(lang, top, mass)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(top), pa.array(mass)], names=names)

        rows = rows.mapInArrow(run, f"{kind}, lang_pred string, score double" if last else f"{kind}, text string, lang string, top double, mass double")
    return rows
