"""Masked pseudo-likelihood scores from a bidirectional window network in numpy.

Each word of a text is predicted from the words on both sides of it; the sum of
the conditional log-probabilities is the document's pseudo-log-likelihood.

Word counts over the whole corpus give the vocabulary. Every other word is one
of `HASHED` classes and, inside its class, a spelling: a model of byte triples,
counted over all those words, gives it a probability of its own. The network
embeds the window (`SIDE` words to either side), has one hidden layer, and
predicts a class in two steps, its group and its place in the group.

Every document trains. Documents are dealt by a hash into shards of a fixed
number of words; in each of `ROUNDS` rounds a part of the shards' documents
goes on from the shared weights in a fixed order, a share `MASK` of the words
being masked and predicted, and the shards' weights are averaged. So neither
partitions nor the size of the corpus change what a shard learns.

Besides, the corpus remembers runs of words: texts are cut where a hash of two
neighbouring words falls on one value of `RUN`, and a run's probability is
1 - `COPY` times the network's, the product of its words', and `COPY` times the
run's share of all runs of the other documents. A document's own runs never
count for itself. This memory grows with the corpus; it is summed and joined by
run, never gathered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import chunks, materialise

WORD = re.compile(r"\w+|[^\w\s]")
#: Groups, and classes in a group.
GROUPS = 64
#: Hashed classes for words outside the vocabulary, and the class of a text's ends.
HASHED, EDGE = 63, 0
#: Words to either side, width of an embedding, hidden units.
SIDE, WIDTH, HIDDEN = 2, 12, 24
#: Share of words masked in training, in per cent; rounds; words to a gradient; step size.
MASK, ROUNDS, STEP, RATE = 15, 2, 1024, 0.066
#: Words in a shard, about.
SHARD_WORDS = 2_000_000
#: Words in a run, on average; weight of the corpus' runs beside the network.
RUN, COPY = 16, 0.1
#: Contexts of the spelling model, by a hash of two bytes; 256 stands for a word's ends.
CONTEXTS, SYMBOLS = 4096, 257
#: Words a task remembers before it starts afresh; bounds a worker's memory only.
MEMO = 400_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n over all documents; tasks add up their own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in chunks(texts, 1_000_000):
                own.update(words("\n".join(t for t in texts[lo:hi] if t)))  # no word reaches over a line's end
                if len(own) > 500_000:
                    yield _counted(own)
                    own = Counter()
        if own:
            yield _counted(own)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(own: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], names=["word", "n"])


# ---------------------------------------------------------------- spelling


def triples(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the cell of its context and symbol, and the word's number."""
    raw = [w.encode("utf-8", "surrogatepass") for w in found]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    code = np.full(size.sum() + 2, 256, np.int64)
    body = np.ones(len(code), bool)
    body[[0, 1]] = False
    ends = np.cumsum(size) + 1
    body[ends] = False
    code[body] = np.frombuffer(b"".join(raw), np.uint8)
    word = np.repeat(np.arange(len(raw)), size)
    one, two = code[1:-1].copy(), code[:-2].copy()
    two[np.cumsum(size) - size] = 256
    context = ((two * SYMBOLS + one) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
    return context * SYMBOLS + code[2:], word


def spelling(counts: DataFrame) -> np.ndarray:
    """Log-probabilities (context, symbol) from the words of `counts` (word, n), all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(CONTEXTS * SYMBOLS)
        for b in batches:
            found, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo, hi in chunks(found, 500_000):
                cell, word = triples(found[lo:hi])
                own += np.bincount(cell, n[lo:hi][word], len(own))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].astype(np.int64))], names=["at", "n"])

    got = counts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # of CONTEXTS x SYMBOLS at most
    table = np.full(CONTEXTS * SYMBOLS, 0.05)
    table[got.column("at").to_numpy()] += got.column("n").to_numpy()
    table = table.reshape(CONTEXTS, SYMBOLS)
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


# ---------------------------------------------------------------- the network


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """np.add.at(to, at, rows) by counting with weights, which numpy does faster."""
    flat = (at[:, None].astype(np.intp) * to.shape[1] + np.arange(to.shape[1])).ravel()
    to += np.bincount(flat, rows.ravel(), to.size).reshape(to.shape)


class Net:
    """Vocabulary, spelling and weights; EDGE and hashed classes come first, then words by count."""

    def __init__(self, vocabulary: list[tuple[str, int]], total: int = 0, spelled: np.ndarray | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        vocabulary = vocabulary[: GROUPS * GROUPS - 1 - HASHED]
        self.index = {w: i + 1 + HASHED for i, (w, _) in enumerate(vocabulary)}
        self.spelled = np.full((CONTEXTS, SYMBOLS), -np.log(SYMBOLS), np.float32) if spelled is None else spelled
        size = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        share = np.full(GROUPS * GROUPS, 0.1)  # the biases begin with the words' shares
        share[1 + HASHED : 1 + HASHED + len(vocabulary)] += [n for _, n in vocabulary]
        share[1 : 1 + HASHED] += max(0, total - sum(n for _, n in vocabulary)) / HASHED
        share = share.reshape(GROUPS, GROUPS)
        self.weights = [
            (rng.standard_normal((GROUPS * GROUPS, WIDTH)) * 0.3).astype(np.float32),  # embeddings
            size(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32),
            size(HIDDEN, GROUPS) * 0.1, np.log(share.sum(axis=1) / share.sum()).astype(np.float32),  # groups
            size(HIDDEN, GROUPS) * 0.1, np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),  # places, with a bias for each group's
        ]

    def classes(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and the log-probability of its spelling inside the class (0 in the vocabulary)."""
        cls = np.fromiter((self.index.get(w, 0) or 1 + crc32(w.encode("utf-8", "surrogatepass")) % HASHED for w in found), np.uint16, len(found))
        cell, word = triples(found)
        spelled = np.bincount(word, self.spelled.ravel()[cell], len(found)) + np.log(HASHED)
        return cls, np.where(cls <= HASHED, np.minimum(spelled, 0), 0)

    def _forward(self, around: np.ndarray, group: np.ndarray):
        """Input, hidden units, and exponentials of the scores of groups and of places in `group`."""
        emb, w1, b1, wg, bg, wp, bp = self.weights
        x = emb.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = x @ w1
        h += b1
        np.tanh(h, out=h)
        a, b = h @ wg, h @ wp
        a += bg
        b += bp.take(group, axis=0)
        # hidden units stay within 1, so scores can only overflow with weights as large as this
        if max(np.abs(w).sum(axis=0).max() + np.abs(c).max() for w, c in ((wg, bg), (wp, bp))) > 80:
            a -= a.max(axis=1, keepdims=True)
            b -= b.max(axis=1, keepdims=True)
        return x, h, a, b

    def log_p(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target class given the classes around it."""
        group, place, i = target // GROUPS, target % GROUPS, np.arange(len(target))
        _, _, a, b = self._forward(around, group)
        own = a[i, group] + b[i, place]
        one = self._ones(a)
        return own - np.log((np.exp(a, out=a) @ one) * (np.exp(b, out=b) @ one))

    @staticmethod
    def _ones(a: np.ndarray) -> np.ndarray:
        return np.ones(a.shape[1], a.dtype)  # a product with ones sums rows faster than sum

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the mean log-probability."""
        emb, w1, b1, wg, bg, wp, bp = self.weights
        group, place = target // GROUPS, target % GROUPS
        x, h, a, b = self._forward(around, group)
        n, i, one = len(target), np.arange(len(target)), self._ones(a)
        da, db = np.exp(a, out=a), np.exp(b, out=b)
        step = a.dtype.type(rate / n)
        da *= (-step / (da @ one))[:, None]
        db *= (-step / (db @ one))[:, None]
        da[i, group] += step
        db[i, place] += step
        dh = da @ wg.T
        dh += db @ wp.T
        dh *= 1 - h * h
        dx = (dh @ w1.T).reshape(-1, WIDTH)
        wg += h.T @ da
        bg += da.sum(axis=0)
        wp += h.T @ db
        hot = np.zeros((n, GROUPS), a.dtype)
        hot[i, group] = 1
        bp += hot.T @ db
        w1 += x.T @ dh
        b1 += dh.sum(axis=0)
        _add_rows(emb, around.ravel(), dx)


class _Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Classes and spellings of words; each distinct word is worked out once."""

    def __init__(self, net: Net):
        self.net, self.memo = net, _Numbers()
        self.cls, self.extra = np.zeros(0, np.uint16), np.zeros(0, np.float16)

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo, self.cls, self.extra = _Numbers(), self.cls[:0], self.extra[:0]
        local = np.fromiter(map(self.memo.__getitem__, found), np.int32, len(found))
        if len(self.memo) > len(self.cls):
            cls, extra = self.net.classes(list(islice(self.memo, len(self.cls), None)))
            self.cls, self.extra = np.concatenate([self.cls, cls]), np.concatenate([self.extra, extra.astype(np.float16)])
        return self.cls[local], self.extra[local]


def encode(docs: DataFrame, net: Net, id_col: str, text_col: str) -> DataFrame:
    """row (a key), doc_id, n_words, ids (classes, 16 bits each), spelled (log-probabilities of the spellings of hashed words, 16 bits each)."""
    given = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(given.value)
        for b in batches:
            texts, n, ids, spelled = b.column(2).to_pylist(), [], [], []
            for lo, hi in chunks(texts, 1_000_000):
                found = [words(t) for t in texts[lo:hi]]
                size = np.fromiter(map(len, found), np.int64, len(found))
                cls, own = coder([w for ws in found for w in ws])
                ends, hashed = np.cumsum(size), cls <= HASHED
                upto = np.r_[0, np.cumsum(hashed)]
                own = own[hashed]
                n += size.tolist()
                ids += [cls[e - k : e].tobytes() for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
                spelled += [own[x:y].tobytes() for x, y in zip(upto[ends - size].tolist(), upto[ends].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(spelled, pa.binary())], names=["row", "doc_id", "n_words", "ids", "spelled"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, ids binary, spelled binary"), "lm-ids")


def _windows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of texts in one array with edges, where the words stand, and which text each is of."""
    edge = np.full(SIDE, EDGE, np.uint16).tobytes()
    ids = np.frombuffer(edge + b"".join(x + edge for x in blobs), np.uint16).astype(np.int32)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
    text = np.repeat(np.arange(len(blobs)), size)
    return ids, np.arange(len(text)) + SIDE * (text + 1), text


def _around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- training


def vocabulary(docs: DataFrame, text_col: str = "text", seed: int = 0) -> tuple[Net, int]:
    """An untrained network with the corpus' vocabulary and spelling, and the number of all words."""
    counts = materialise(word_counts(docs, text_col), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(GROUPS * GROUPS - 1 - HASHED).collect()]
    known = F.lit(False)
    if len(top) == GROUPS * GROUPS - 1 - HASHED:  # the last in order: everything after it is outside
        word, n = top[-1]
        known = (F.col("n") > n) | (F.col("n") == n) & (F.col("word") <= word)
        counts = counts.where(~known)
    return Net(top, total, spelling(counts), seed), total


def train(coded: DataFrame, net: Net, total: int, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> Net:
    """`net` with weights trained on every row of `coded` (see `encode`).

    A row is dealt to a shard and a round by a hash of its id and classes, and
    a shard takes its rows in the order of that hash, so the result depends on
    the rows alone but for rounding. Rows of null id and repeated rows train
    like others; with nothing to train on, the starting weights stay.
    """
    shards = max(1, -(-total // shard_words))
    sc = coded.sparkSession.sparkContext
    h = F.xxhash64(F.col("doc_id").cast("string"), "ids")
    rows = coded.where("n_words > 0").select(F.pmod(h, F.lit(shards)).alias("shard"), F.pmod(F.floor(h / shards), F.lit(rounds)).alias("round"), h.alias("h"), "ids")
    for r in range(rounds):
        given = sc.broadcast(net)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], given=given, rate=RATE / (r + 1) * STEP**0.5) -> Iterator[pa.RecordBatch]:
            start, own, now, total, seen = given.value, None, None, 0, 0

            def learn(blobs: list[bytes], salts: np.ndarray) -> int:
                ids, at, text = _windows(blobs)
                pick = _mix(salts[text].view(np.uint64) + at.astype(np.uint64)) % np.uint64(100) < MASK
                at = at[pick]
                order = np.random.default_rng(len(at)).permutation(len(at))
                at = at[order]
                for k in range(0, len(at), STEP):
                    own.learn(_around(ids, at[k : k + STEP]), ids[at[k : k + STEP]], rate)
                return len(at)

            def flat() -> np.ndarray:
                return np.concatenate([w.ravel() for w in own.weights]).astype(np.float64)

            words_now = 0
            for b in batches:
                shard, salt, blobs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
                cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if shard[lo] != now:
                        total, seen = (total + flat() * words_now if own else total), seen + words_now
                        own, now, words_now = Net.__new__(Net), shard[lo], 0
                        own.weights = [w.copy() for w in start.weights]
                    words_now += learn(blobs[lo:hi], salt[lo:hi])
            if own:
                total, seen = total + flat() * words_now, seen + words_now
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, seen))], names=["i", "v"])

        part = rows.where(F.col("round") == r).select("shard", "h", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids")
        sums = part.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row for each weight
        if not sums.num_rows:
            continue
        v = np.zeros(sums.num_rows)
        v[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        mean, at, new = (v[:-1] / v[-1]).astype(np.float32), 0, []
        for w in net.weights:
            new.append(mean[at : at + w.size].reshape(w.shape))
            at += w.size
        net.weights = new
    return net


# ---------------------------------------------------------------- scoring


def score_texts(net: Net, ids_of: list[bytes], spelled_of: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Summed log-probability of each text by the network, and its runs.

    Of those it gives text, a hash of the run, times in the text, and
    log-probability by the network; one row for each distinct run of a text.
    """
    total, noted = np.zeros(len(ids_of)), []
    for lo, hi in chunks(ids_of, 80_000):
        ids, at, text = _windows(ids_of[lo:hi])
        if not len(at):
            continue
        around, target = _around(ids, at), ids[at]
        log_p = np.concatenate([net.log_p(around[k : k + 1024], target[k : k + 1024]) for k in range(0, len(at), 1024)]).astype(np.float64)
        bits = np.zeros(len(at), np.uint16)
        hashed = target <= HASHED
        own = np.frombuffer(b"".join(spelled_of[lo:hi]), np.float16)
        bits[hashed] = own.view(np.uint16)
        log_p[hashed] += own
        total[lo:hi] += np.bincount(text, log_p, hi - lo)
        word = _mix(target.astype(np.uint64) << np.uint64(16) | bits)
        cut = np.r_[True, (_mix(word[:-1] + np.uint64(3) * word[1:]) % np.uint64(RUN) == 0) | (text[1:] != text[:-1])]
        first = np.flatnonzero(cut)
        place = np.arange(len(at)) - first[np.cumsum(cut) - 1]
        run = np.add.reduceat(_mix(word + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
        t, p = text[first], np.add.reduceat(log_p, first)
        order = np.lexsort((run, t))
        t, run, p = t[order], run[order], p[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (run[1:] != run[:-1])])
        noted.append((t[new] + lo, run[new].view(np.int64), np.diff(np.r_[new, len(order)]), p[new]))
    return total, noted


def score_documents(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (summed) and mean_log_p of every whole text.

    Without `net` a network is trained on `docs`. The memory of runs is always
    that of `docs`, each row's own left out. Null texts and texts without a
    word have 0 words, likelihood 0 and a null mean. Repeated rows are each
    scored, and speak for one another; null ids and ids of any type are kept;
    other columns are not read; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    if net is None:
        net, total = vocabulary(docs, text_col)
        coded = encode(docs, net, id_col, text_col)
        net = train(coded, net, total)
    else:
        coded = encode(docs, net, id_col, text_col)
    given = sc.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(3).to_pylist()
            total, noted = score_texts(given.value, blobs, b.column(4).to_pylist())
            text, run, n, p = (np.concatenate(x) for x in zip(*noted, strict=True)) if noted else (np.zeros(0, np.int64),) * 4
            runs = pa.StructArray.from_arrays([pa.array(run, pa.int64()), pa.array(n, pa.int32()), pa.array(p.astype(np.float32), pa.float32())], names=["run", "n", "p"])
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=len(blobs)))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(total), pa.ListArray.from_arrays(offsets, runs)], names=["row", "doc_id", "n_words", "by_net", "runs"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    scored = materialise(coded.mapInArrow(run, f"row long, doc_id {kind}, n_words long, by_net double, runs array<struct<run:bigint,n:int,p:float>>"), "lm-scored")
    rows = scored.select("row", "doc_id", "n_words", (F.col("by_net") + np.log(1 - COPY) * _times("runs")).alias("by_net")).join(_copied(scored), "row", "left")
    rows = rows.select("doc_id", "n_words", (F.col("by_net") + F.coalesce("gain", F.lit(0.0))).alias("log_likelihood"))
    return rows.withColumn("mean_log_p", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def _times(runs: str) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def _copied(scored: DataFrame) -> DataFrame:
    """row and gain: what runs that other rows hold too add to a row's log-likelihood."""
    noted = scored.select("row", F.explode("runs").alias("x")).select("row", "x.*")
    shared = noted.groupBy("run").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    every = scored.agg(F.coalesce(F.sum(_times("runs")), F.lit(0))).first()[0]
    met = noted.join(shared, "run")
    net, copy = F.col("p").cast("double") + np.log(1 - COPY), F.log((F.col("all") - F.col("n")) * F.lit(COPY / max(1, every)))
    both = F.greatest(net, copy) + F.log1p(F.exp(-F.abs(net - copy)))
    return met.groupBy("row").agg(F.sum(F.col("n") * (both - net)).alias("gain"))
