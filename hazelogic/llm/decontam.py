"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

The automaton holds every window of the normalised test items. Each text is
scanned once; a match's end gives its last word, and the words' offsets map the
hits back to the original text. Nothing of the documents is shuffled. A set of
items beyond `BLOCK_CHARS` is dealt over several automata, which the texts then
pass one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import as_row, ascii_lower

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Characters of item texts that one automaton is built from. A window repeats
#: each word up to ten times, so an automaton stays under about 150 MB.
BLOCK_CHARS = 200_000


def words(text: str | None) -> list[str]:
    """Lower-cases A-Z and takes the runs of letters and digits."""
    return WORD.findall(ascii_lower(text))


def windows(text: str | None, size: int) -> list[tuple[str, ...]]:
    """All runs of `size` words; a shorter text with words is one window."""
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class Matcher:
    """The automaton of a block of items, and what its matches mean."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        import ahocorasick

        owners: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).update([] if item is None else [item])
        self.auto, self.meant = ahocorasick.Automaton(), []
        for w, own in owners.items():
            self.auto.add_word(f" {' '.join(w)} ", len(self.meant))
            self.meant.append((len(w), frozenset(own)))
        if owners:
            self.auto.make_automaton()

    def scan(self, found: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words inside a match, merged and in order, and the items matched."""
        if not self.meant or not found:
            return [], set()
        hits = list(self.auto.iter(f" {' '.join(found)} "))
        if not hits:
            return [], set()
        ends = np.cumsum([len(w) + 1 for w in found])  # where the space after each word stands
        last = np.searchsorted(ends, [e for e, _ in hits])
        items = set().union(*(self.meant[k][1] for k in {k for _, k in hits}))
        return merged([(int(i) - self.meant[k][0] + 1, int(i) + 1) for i, (_, k) in zip(last, hits, strict=True)]), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


@lru_cache(maxsize=1)
def _matcher(items: tuple, size: int) -> Matcher:
    return Matcher(list(items), size)


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Which words of each document stand in a window of a test item.

    Returns per row of `docs`: row (a struct of the columns `carry`, of any
    names and types), n_words, n_hit (words inside any occurrence of a window),
    items (array of matched item ids as strings, sorted), spans (array of the
    begin and end of each hit run in characters of the original text).

    Null and empty texts have no words and no hits. An item of null id is
    matched but not listed; equal windows of several items count for each of
    them; repeated rows of items change nothing; repeated documents are each
    returned. With no items nothing is hit; an empty table of documents gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, ceil(total / block_chars))
    rows = docs.select(as_row(docs, carry), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}"
    between, after = f"{kind}, text string, hit array<int>, items array<string>", f"{kind}, n_words long, n_hit long, items array<string>, spans array<struct<`begin`:long,`end`:long>>"
    for k in range(n):
        block = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text")
        given = spark.sparkContext.broadcast(tuple((r.item, r.text) for r in block.collect()))  # of about block_chars
        rows = rows.mapInArrow(_scanner(given, size, k == n - 1), after if k == n - 1 else between)
    return rows


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scanner(given, size: int, last: bool):
    """Scans batches with one automaton; the last one also reports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(given.value, size)
        for b in batches:
            hit, items, n_words, n_hit, spans = [], [], [], [], []
            for text, h, i in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                found = WORD.findall(low := ascii_lower(text))
                ranges, own = m.scan(found)
                items.append(sorted({*i, *own}))
                if not last:
                    hit.append(h + [x for r in ranges for x in r])
                    continue
                ranges = merged([*ranges, *zip(h[::2], h[1::2], strict=True)])
                at = [w.span() for w in WORD.finditer(low)] if ranges else []
                n_words.append(len(found))
                n_hit.append(sum(hi - lo for lo, hi in ranges))
                spans.append([{"begin": at[lo][0], "end": at[hi - 1][1]} for lo, hi in ranges])
            if last:
                cols = {"row": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, _SPANS)}
            else:
                cols = {"row": b.column(0), "text": b.column(1), "hit": pa.array(hit, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return run


def digest(found: DataFrame) -> DataFrame:
    """The fixed digest columns of a result of `find_contamination`."""
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()
