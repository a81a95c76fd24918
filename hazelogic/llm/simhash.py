"""SimHash near-duplicates by binary-trie self-joins.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles. Two fingerprints of at most k differing bits agree wholly on at least
b - k of b blocks of bits, so every choice of b - k blocks keys one copy of the
distinct fingerprints, and each bucket of equal keys is a binary trie that is
joined with itself: pairs of nodes go down together, the bits that differ add
up, and a pair is dropped once they exceed k. Pairs of nodes whose leaves are
all linked already are not opened again, so a bucket of very many near copies
gives the links of a spanning forest, never all its pairs. Links between
buckets meet in a distributed connected-components run over fingerprints.

`near_copies` takes the same join to texts of Jaccard similarity 0.8, where
four bits of 64 find next to nothing, and compares what it finds exactly: see
`Wide`. What the fingerprints miss, an exact join of prefixes between the
groups found so far completes: see `missed`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import as_row, chosen, materialise

BITS = 64
#: Pairs handled in one numpy step, and rows joined at a time; these bound memory only.
STEP_PAIRS, BATCH_ROWS = 400_000, 300_000
#: Cells of at most this many pairs are compared directly.
DIRECT = 36
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest as h

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(w), max(1, len(w) - shingle + 1)
    if n == 1:
        return np.array([h(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """The bits set in over half the values; 0 without values."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text as an unsigned number; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def _mixed(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th of independent 64-bit hashes made from 64-bit hashes (the splitmix64 finaliser)."""
    x = x + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (of its own type) and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- the trie join


def block_masks(n: int, k: int) -> list[int]:
    """Masks of key bits: more blocks for more fingerprints, so buckets stay small.

    Longer keys mean more copies of each fingerprint; a bucket of a few hundred
    is joined faster than those copies are moved.
    """
    b = k + 1
    while b - k < 4 and n > (256 << round(BITS * (b - k) / b)) and comb(b + 1, k) <= 70:
        b += 1
    cuts = [round(i * BITS / b) for i in range(b + 1)]
    parts = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(b)]
    return [sum(c) for c in combinations(parts, b - k)]


def _below(x: np.ndarray) -> np.ndarray:
    """All bits at or below the highest set bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return x


def _expand(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a row in range a = (lo, hi) and one in range b, for each column."""
    na, nb = a[1] - a[0], b[1] - b[0]
    n = na * nb
    cell = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[0][cell] + k // nb[cell], b[0][cell] + k % nb[cell]


class Forest:
    """Labels of rows: the least row that each is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        lab = self.label
        while True:
            a, b = lab[i], lab[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(lab, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := lab[lab] != lab).any():
                lab[up] = lab[lab[up]]
        self.changes = np.concatenate(([0], np.cumsum(lab[1:] != lab[:-1])))

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all rows of both ranges have one label."""
        c = self.changes
        return (c[a[1] - 1] == c[a[0]]) & (c[b[1] - 1] == c[b[0]]) & (self.label[a[0]] == self.label[b[0]])


class Found:
    """Pairs of rows to look at again: one for each pair of labels, of rows that really are that near."""

    def __init__(self, unite: bool, i: list | None = None, j: list | None = None):
        self.unite, self.i, self.j, self.done = unite, i or [], j or [], np.zeros(0, np.int64)

    def code(self, forest: Forest, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = forest.label[i], forest.label[j]
        return np.minimum(a, b) * len(forest.label) + np.maximum(a, b)

    def add(self, forest: Forest, i: np.ndarray, j: np.ndarray) -> None:
        new = forest.label[i] != forest.label[j]
        i, j = i[new], j[new]
        code, first = np.unique(self.code(forest, i, j), return_index=True)
        first = first[~np.isin(code, self.done)]
        self.i.append(i[first])
        self.j.append(j[first])
        if self.unite:
            forest.link(i, j)
        else:
            self.done = np.union1d(self.done, code)


def trie_join(fp: np.ndarray, starts: np.ndarray, k: int, more: np.ndarray | None = None, k_all: int = 0, forest: Forest | None = None, found: Found | None = None) -> np.ndarray:
    """For each row the least row it is linked to inside its bucket.

    fp: unsigned fingerprints, ascending inside each bucket, and distinct there
    unless `more` is given; starts: where the buckets begin, and the number of
    rows. With `more` (further bits, a row of words for each fingerprint) a
    link also needs at most k_all differing bits in all. Fingerprints equal in
    their first word are compared with the first of them and their neighbour,
    so with `more` not every link need be found.
    `found` gathers the pairs that make links; where it does not unite, pairs
    are noted once for each two labels and nothing is linked.
    """
    forest = forest or Forest(len(fp))
    size = np.diff(starts)
    many = size > 1
    first = np.stack([starts[:-1][many], starts[1:][many]])
    stack = [(first[:, at : at + STEP_PAIRS // DIRECT], None) for at in range(0, first.shape[1], STEP_PAIRS // DIRECT)]

    def near(i: np.ndarray, j: np.ndarray) -> None:
        hit = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= k)
        i, j = i[hit], j[hit]
        if more is not None:
            both = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(more[i] ^ more[j]).sum(axis=1) <= k_all
            i, j = i[both], j[both]
        if not len(i):
            return
        if found is None:
            forest.link(i, j)
        else:
            found.add(forest, i, j)

    while stack:
        a, b = stack.pop()
        alone = b is None  # a node with itself
        if alone:
            open_ = ~forest.joined(a, a)
            a = b = a[:, open_]
        else:
            open_ = ~forest.joined(a, b)
            if found is not None and len(found.done):
                open_ &= ~(forest.joined(a, a) & forest.joined(b, b) & np.isin(found.code(forest, a[0], b[0]), found.done))
            a, b = a[:, open_], b[:, open_]
            under = _below(fp[a[0]] ^ fp[a[1] - 1]) | _below(fp[b[0]] ^ fp[b[1] - 1])
            far = np.bitwise_count((fp[a[0]] ^ fp[b[0]]) & ~under)
            a, b, under, far = (x[..., far <= k] for x in (a, b, under, far))
            sure = (far + np.bitwise_count(under) <= k) & (more is None)  # whatever the bits below are
            if sure.any():
                i, j = _expand(np.stack([a[0], a[1]])[:, sure], np.stack([b[0], b[0] + 1])[:, sure])
                x, y = _expand(np.stack([a[0], a[0] + 1])[:, sure], np.stack([b[0], b[1]])[:, sure])
                forest.link(np.concatenate([i, x]), np.concatenate([j, y]))
                a, b = a[:, ~sure], b[:, ~sure]
        if not a.shape[1]:
            continue
        small = (a[1] - a[0]) * (b[1] - b[0]) <= DIRECT
        if small.any():
            near(*_expand(a[:, small], b[:, small]))
            a, b = a[:, ~small], b[:, ~small]
        flat = (fp[a[0]] == fp[a[1] - 1]) & (fp[b[0]] == fp[b[1] - 1])
        if flat.any():  # nothing to descend into
            u, v = a[:, flat], b[:, flat]
            i, j = _expand(u, np.stack([v[0], v[0] + 1]))
            x, y = _expand(np.stack([u[0], u[0] + 1]), v)
            near(np.concatenate([i, x]), np.concatenate([j, y]))
            if alone:
                near(i, np.minimum(i + 1, np.repeat(u[1] - 1, u[1] - u[0])))
            a, b = a[:, ~flat], b[:, ~flat]
        if not a.shape[1]:
            continue
        if alone:
            lo, hi = _children(fp, a)
            cross, own = (lo, hi), np.concatenate([lo, hi], axis=1)
            own = own[:, own[1] - own[0] > 1]
            _push(stack, *cross)
            _push(stack, own, None)
        else:  # the node that splits at the higher bit goes down
            high = (fp[a[0]] ^ fp[a[1] - 1]) >= (fp[b[0]] ^ fp[b[1] - 1])
            top, other = np.where(high, a, b), np.where(high, b, a)
            lo, hi = _children(fp, top)
            _push(stack, np.concatenate([lo, hi], axis=1), np.concatenate([other, other], axis=1))
    return forest.label


def _push(stack: list, a: np.ndarray, b: np.ndarray | None) -> None:
    step = STEP_PAIRS // DIRECT
    for at in range(0, a.shape[1], step):
        stack.append((a[:, at : at + step], None if b is None else b[:, at : at + step]))


def _children(fp: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two child ranges of each node, cut at the highest bit that differs in it."""
    x = _below(fp[a[0]] ^ fp[a[1] - 1])
    goal = (fp[a[1] - 1] & ~x) | (x ^ (x >> np.uint64(1)))
    lo, hi = a[0].copy(), a[1].copy()
    while (more := lo < hi).any():
        mid = (lo + hi) >> 1
        less = fp[np.minimum(mid, len(fp) - 1)] < goal
        lo = np.where(more & less, mid + 1, lo)
        hi = np.where(more & ~less, mid, hi)
    return np.stack([a[0], lo]), np.stack([lo, a[1]])


def _bucket_links(k: int, levels: tuple[int, ...] = ()):
    """Links of buckets from batches of (c, key, fp, rep) and, for wide fingerprints, more words and a root.

    With `levels`, budgets of wide fingerprints in ascending order, the pairs
    are those that unite groups level by level, and at the last level one for
    each two groups; every pair is of rows that near. Rows of one root are
    one group from the start and make no pairs.
    """

    def links(c: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, *more: np.ndarray) -> pa.RecordBatch | None:
        new = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], new, [len(fp)]))
        order = np.lexsort((*reversed(more), fp, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        fp, rep = fp[order], rep[order]
        if not levels:
            label = trie_join(fp, starts, k)
            i = np.flatnonzero(label != np.arange(len(label)))
            j = label[i]
        else:
            words, root = np.stack(more[:-1], axis=1)[order].view(np.uint64), more[-1][order]
            forest, found = Forest(len(fp)), None
            bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            by_root = np.lexsort((root, bucket))
            new = np.r_[True, (np.diff(bucket[by_root]) != 0) | (np.diff(root[by_root]) != 0)]
            forest.link(by_root, by_root[np.flatnonzero(new)[np.cumsum(new) - 1]])
            for level in levels:
                found = Found(level != levels[-1], *((found.i, found.j) if found else ()))
                trie_join(fp, starts, min(k, level), words, level, forest, found)
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found.i, found.j))
            i, j = _to_hubs(i, j, forest.label, rep, np.column_stack([fp, words]), levels[-1] // 2)
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
        return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"]) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
            rows += b.num_rows
            if rows < BATCH_ROWS:
                continue
            c, key, fp, rep, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.flatnonzero((c != c[-1]) | (key != key[-1]))
            at = cut[-1] + 1 if len(cut) else 0  # the last bucket may go on in the next batch
            if at and (out := links(c[:at], key[:at], fp[:at].view(np.uint64), rep[:at], *(m[:at] for m in more))):
                yield out
            held = [[c[at:], key[at:], fp[at:], rep[at:], *(m[at:] for m in more)]]
            rows = 0 if at else -len(c)
        if held:
            c, key, fp, rep, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(c) and (out := links(c, key, fp.view(np.uint64), rep, *more)):
                yield out

    return run


def _to_hubs(i: np.ndarray, j: np.ndarray, label: np.ndarray, rep: np.ndarray, words: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, those inside a group of one label led over its row of least rep where both ends are that near to it.

    Buckets that share a group's rows then mostly name the same pairs, so a
    large group of near copies makes a few pairs a row and not one a bucket.
    """
    order = np.lexsort((rep, label))
    first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
    hub = np.zeros(len(label), np.int64)
    hub[label[first]] = first
    hub = hub[label]
    close = np.bitwise_count(words ^ words[hub]).sum(axis=1) <= near
    led = (label[i] == label[j]) & close[i] & close[j]
    ends = np.unique(np.concatenate([i[led], j[led]]))
    ends = ends[hub[ends] != ends]
    return np.concatenate([i[~led], ends]), np.concatenate([j[~led], hub[ends]])


def similar_pairs(classes: DataFrame, k: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`, a spanning forest of each bucket.

    Two fingerprints of at most k differing bits end up connected through
    links; every link is between such fingerprints or the root of what they
    connect.
    """
    masks = block_masks(classes.count(), k)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]))
    rows = classes.select(keys.alias("k"), "fp").select("k.c", "k.key", "fp")
    dealt = rows.repartition("c", "key").sortWithinPartitions("c", "key").select("c", "key", "fp", F.col("fp").alias("rep"))
    return dealt.mapInArrow(_bucket_links(k), "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node on an edge (a, b).

    Large-star and small-star steps: each links the neighbours of a node to the
    least of them, until nothing changes. Minima are partial aggregates and the
    joins' hot keys are split by Spark, so no neighbourhood is gathered.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, k: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable over links of at most k
    differing bits, the document itself included; ids keep their type. Null
    and empty texts have fingerprint zero and link like any other; repeated
    rows are each returned; rows of null id take part, but name no component
    unless no row there has an id (it is null then). Other columns are not
    read; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(similar_pairs(classes, k))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "rep")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.drop("rep").join(named, "root").drop("root")
    out = prints.join(known, F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity


@dataclass(frozen=True)
class Wide:
    """How `near_copies` finds texts of a Jaccard similarity.

    Sets of similarity J differ in a share p = arccos(2J / (1 + J)) / pi of the
    bits, which is 38 of 256 at 0.8. Keys are samples of `key_bits` of the 256
    bits, as many as make two texts at `similarity` meet in a bucket with
    probability `meet`, however many texts there are; in a bucket the trie join
    prunes at `first_budget` of the first 64 bits and takes pairs of up to
    `budget` of 256 as candidates. Both budgets are p and three deviations of
    the binomial. Candidates are then compared exactly. The first `first_keys`
    keys go ahead, so that the others meet large groups already united.
    """

    similarity: float = 0.8
    meet: float = 0.99
    seed: int = 42
    first_keys: int = 2

    @property
    def p(self) -> float:
        return acos(2 * self.similarity / (1 + self.similarity)) / pi

    def _budget(self, bits: int) -> int:
        return round(bits * self.p + 3 * (bits * self.p * (1 - self.p)) ** 0.5)

    @property
    def first_budget(self) -> int:
        return self._budget(BITS)

    @property
    def budget(self) -> int:
        return self._budget(4 * BITS)

    @property
    def levels(self) -> tuple[int, ...]:
        return (self.budget // 4, self.budget // 2, self.budget)

    def masks(self, n: int) -> list[tuple[int, int]]:
        """(word, mask) of each key; keys get longer, and more, beyond 256 texts a bucket."""
        key_bits = max(12, ceil(log2(max(n, 1))) - 8)
        tables = ceil(log(1 - self.meet) / log(1 - (1 - self.p) ** key_bits))
        rng = np.random.default_rng(self.seed)
        return [(t % 4, sum(1 << int(i) for i in rng.choice(BITS, key_bits, replace=False))) for t in range(tables)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


#: Shingles counted at a time, and the most of those in several texts that the order of `missed` puts last.
COUNTED, COMMON = 2_000_000, 1 << 17


def near_copies(docs: DataFrame, how: Wide = Wide(), shingle: int = 5, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, a struct of all columns of any names, and key) and groups (key and component).

    Rows get a key of their own, written once, so ids play no part: null and
    repeated ids and wholly repeated rows count as rows like any other.
    component is the least key reachable over links between rows whose sets of
    word shingles have at least the similarity; rows of equal sets, and all
    rows without words (null, empty), are linked. Candidates come from the
    trie join of 256 bits (see `Wide`), one pair for each two groups of a
    bucket, and become links only if their sets, compared in full, are that
    similar. Links between different groups that the fingerprints miss are
    then found by `missed`, so none is left out. Whole texts are read; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "mark", "fp", "w1", "w2", "w3", "shingle", "texts"]
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            values, n = values[n > 1].view(np.int64), n[n > 1]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(n), t) for t in (pa.int64(), pa.binary(), *[pa.int64()] * 4)), pa.array(values), pa.array(n.astype(np.int64))], names=names)

        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle, how.seed)) for t in b.column(1).to_pylist()]
            fp = np.array([[majority(v), *(majority(_mixed(v, i)) for i in (1, 2, 3))] for v in sets], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            mark = pa.array([sha256(v.tobytes()).digest()[:16] for v in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), mark, *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(4)), *[pa.nulls(len(sets), pa.int64())] * 2], names=names)
            held.append(np.concatenate([np.zeros(0, np.uint64), *sets]))
            if sum(map(len, held)) >= COUNTED:
                yield counted()
                held.clear()
        yield counted()

    rows = materialise(docs.select(as_row(docs), F.monotonically_increasing_id().alias("key")), "rows")
    texts = rows.select("key", F.col(f"row.`{text_col}`").alias("text"))
    both = materialise(texts.mapInArrow(run, "key long, mark binary, fp long, w1 long, w2 long, w3 long, shingle long, texts long"), "fingerprints")
    prints, words = both.where("key IS NOT NULL"), ["fp", "w1", "w2", "w3"]
    classes = materialise(prints.groupBy("mark").agg(F.min(F.struct(F.col("key").alias("rep"), *words)).alias("m")).select("mark", "m.*"), "classes")
    keys = [F.struct(F.lit(c).alias("c"), F.col(words[w]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("k")) for c, (w, m) in enumerate(how.masks(classes.count()))]
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for some in (keys[: how.first_keys], keys[how.first_keys :]):
        if some:
            keyed = _rooted(classes, roots).select(F.explode(F.array(*some)).alias("k"), *words, "rep", "root").select("k.c", "k.k", "fp", "rep", "w1", "w2", "w3", "root")
            pairs = keyed.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_bucket_links(how.first_budget, how.levels), "a long, b long")
            roots = _extended(roots, pairs, texts, how, shingle)
    common = both.where("key IS NULL").groupBy("shingle").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "shingle").limit(COMMON).select("shingle").toArrow()
    pairs = missed(texts, classes, roots, common.column(0).to_numpy().view(np.uint64), how, shingle)
    rooted = _rooted(classes, _extended(roots, pairs, texts, how, shingle)).select("mark", F.col("root").alias("component"))
    return rows, prints.select("key", "mark").join(rooted, "mark").drop("mark")


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """`classes` with the root of each, its own rep where none is linked to it."""
    return classes.join(roots, F.col("rep") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "rep"))


def _extended(roots: DataFrame, pairs: DataFrame, texts: DataFrame, how: Wide, shingle: int) -> DataFrame:
    """The components of what `roots` link and of those candidate pairs that are similar enough."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    return components(similar(pairs, texts, how, shingle).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def missed(texts: DataFrame, classes: DataFrame, roots: DataFrame, common: np.ndarray, how: Wide, shingle: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots, all those of at least the similarity among them.

    Two sets of similarity t or more share an element among the first
    n - ceil(t n) + 1 of each in any order that holds for all sets. The order
    is by hash, with the elements `common` (most frequent first) at its end:
    which those are changes the number of candidates and no link. From where a
    shared element stands follows how many can be shared in all; pairs that
    cannot reach the similarity are dropped, and so are those of one root, so
    a large group makes no pairs inside itself.
    """
    by_value = np.argsort(common)
    given = texts.sparkSession.sparkContext.broadcast((common[by_value], len(common) - by_value))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = given.value
        for b in batches:
            size, first = [], []
            for t in b.column(1).to_pylist():
                v = np.unique(shingle_hashes(t, shingle, how.seed))
                late = np.zeros(len(v), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    late = np.where(known[at] == v, rank[at], 0)
                size.append(len(v))
                first.append(v[np.lexsort((v, late))[: len(v) - ceil(how.similarity * len(v) - 1e-9) + 1]])
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), tokens], names=["rep", "n", "tokens"])

    held = chosen(texts, classes.select(F.col("rep").alias("key")), "class-keys", prefix, "rep long, n long, tokens array<long>")
    dealt = _rooted(held, roots).select(F.posexplode("tokens").alias("at", "token"), "root", "rep", "n").repartition("token").sortWithinPartitions("token")
    return dealt.select("token", "root", "rep", "n", F.col("at").cast("long").alias("at")).mapInArrow(_across(how.similarity), "a long, b long")


def _across(least: float):
    """Pairs between roots from batches of (token, root, rep, n, at) sorted by token, once a batch each."""

    def pairs(token: np.ndarray, root: np.ndarray, rep: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((root, token))
        token, root, rep, n, at = (x[order] for x in (token, root, rep, n, at))
        new = token[1:] != token[:-1]
        ends = np.append(np.flatnonzero(new), len(token) - 1) + 1
        end = ends[np.searchsorted(ends, np.arange(len(token)), "right")]  # of the token's rows
        ends = np.append(np.flatnonzero(new | (root[1:] != root[:-1])), len(token) - 1) + 1
        start = ends[np.searchsorted(ends, np.arange(len(token)), "right")]  # of its rows of other roots
        rows = np.flatnonzero(end > start)
        todo = np.cumsum(end[rows] - start[rows])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + STEP_PAIRS, "right")))
            r = rows[lo:hi]
            i, j = _expand(np.stack([r, r + 1]), np.stack([start[r], end[r]]))
            most = np.minimum(n[i] - at[i], n[j] - at[j])
            may = most * (1 + least) >= least * (n[i] + n[j]) - 1e-6
            a, b = rep[i[may]], rep[j[may]]
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(5)])
            rows += b.num_rows
            if rows < BATCH_ROWS:
                continue
            all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = int(np.searchsorted(all_[0], all_[0][-1]))  # the last token may go on in the next batch
            if at:
                yield from pairs(*(x[:at] for x in all_))
            held = [[x[at:] for x in all_]]
            rows = 0 if at else -len(all_[0])
        if held:
            all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(all_[0]):
                yield from pairs(*all_)

    return run


def similar(pairs: DataFrame, texts: DataFrame, how: Wide, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose texts, given as key and text, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, np.ndarray] = {}
            keep = []
            for i, j, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for k, t in ((i, x), (j, y)):
                    if k not in held:
                        held[k] = np.unique(shingle_hashes(t, shingle, how.seed))
                keep.append(similarity(held[i], held[j]) >= how.similarity)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    need = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = materialise(chosen(texts, need, "candidate-keys"), "candidate-texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
