"""The ten operators against brute force, on hand-made edge cases and on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazelogic.llm import decontam, html_extract, langid, licenses, lm_score, mixing, quality, simhash, tokens, warc
from hazelogic.llm.common import new_path

TINY = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "Ünï ▁x  y"), (7, "a" * 200_000 + " b")]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None, "x") for i, t in EDGE], "doc_id long, text string, lang string, source string, n_tokens string")


def texts(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    return [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("table_bytes", [0, 200, tokens.TABLE_BYTES])
def test_tokens(spark, edge, table_bytes):
    """As the library counts, with no frequent pre-token, a few, or all that occur twice looked up."""
    import public_tokenizers
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    odd = [" ", "a ", "  a", "▁a▁", "x\r y", "<s> </s>", "日本 語", "\x00 a", "the the the of of it", "x" * 3000 + " " + "x" * 3000, *texts(20)]
    docs = edge.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, n_tokens string"))
    rows = EDGE + [(100 + i, t) for i, t in enumerate(odd)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs.repartition(3), file, table_bytes=table_bytes).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in rows)
    table = tokens.frequent(docs, file, table_bytes=table_bytes)
    assert sum(len(t.encode()) + tokens.ENTRY for t in table) <= table_bytes and (not table_bytes or " the" in table or table_bytes < 1000)
    assert tokens.count_tokens(edge.limit(0), file).count() == 0


def brute_hits(text, items, size=10):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w, hit, own = WORDS.findall(low), set(), set()
    for item, t in items:
        v = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        for win in [v[i : i + size] for i in range(max(1, len(v) - size + 1))] if v else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    own.add(str(item))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 60])
def test_decontamination(spark, block):
    base = texts(6, 9)
    items = [(10, base[0]), (9, base[1]), (9, base[1]), (3, "Short one"), (4, None), (5, " ! ")]
    docs = [(1, None), (2, ""), (3, base[0].upper() + " tail"), (4, "x SHORT, one y short one"), (5, " ".join(base[1].split()[:12])), (6, base[2]), (6, base[2])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.find_contamination(d, b, block_chars=block).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in docs)
    assert {r.n_hit for r in decontam.find_contamination(d, b.limit(0)).collect()} == {0}
    odd = spark.createDataFrame([("x", base[0] + " y" * 200_000, 1, "q"), (None, base[1], 2, "r")], "doc_id string, text string, items int, n_hit string")
    found = decontam.find_contamination(odd, b, block_chars=block, carry=("doc_id", "items", "n_hit")).collect()
    assert sorted((r.row["items"], r.row.n_hit, r.n_words, r.n_hit, r["items"]) for r in found) == [(1, "q", len(base[0].split()) + 200_000, len(base[0].split()), ["10"]), (2, "r", len(base[1].split()), len(base[1].split()), ["9"])]
    span = decontam.find_contamination(d, b).where("row.doc_id = 4").first().spans
    assert [docs[3][1][s["begin"] : s["end"]] for s in span] == ["SHORT, one", "short one"]


def test_html():
    model = html_extract.trained()
    held = html_extract.labelled_pages(60, seed=123)
    right = [int((model.decode(html_extract.features(p)) == y).sum()) for p, y in held]
    assert sum(right) / sum(len(y) for _, y in held) > 0.97
    assert html_extract.main_text(None, model) == html_extract.main_text("", model) == html_extract.main_text("<script>x</script><style>p", model) == ""
    page = "<html><head><title>no</title></head><body><nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>A&amp;B</h1><p>First  <b>bold</b> text, and more of it.<p>Second\n text is here too.</article><footer>&copy; us</footer>"
    assert html_extract.main_text(page, model) == "A&B First bold text, and more of it. Second text is here too."
    page = "<article><p>One <math><mi>x</mi></math> <object>two</object> of it, <svg><title>icon</title></svg>three.</p><select><option>no</option><p>Four is here and goes on.</p></article>"
    assert html_extract.main_text(page, model).startswith("One x two of it, three.")


MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/b'>News</a></li></ul>"
FOOT = "<footer>&copy; 2020 Some Company</footer>"
#: Layouts around the paragraphs of an article; none comes from the generator.
LAYOUTS = {
    "article": "<html><body><article>{}</article></body></html>",
    "main": "<html><body><main>{}</main></body></html>",
    "noisy body": f"<html><body class='single has-sidebar'><nav>{MENU}</nav><article>{{}}</article>{FOOT}</body></html>",
    "noisy outer": f"<html><body><div class='comments-open'><nav>{MENU}</nav><article>{{}}</article>{FOOT}</div></body></html>",
    "noisy outer main": f"<html><body><div class='comments-open'><nav>{MENU}</nav><main>{{}}</main>{FOOT}</div></body></html>",
    "noisy wrap": "<html><body><div class='main-menu-open page-wrap'><article>{}</article></div></body></html>",
    "noisy wrap alone": "<html><body><div class='main-menu-open page-wrap'>{}</div></body></html>",
    "noisy article": f"<html><body><nav>{MENU}</nav><article class='post tag-news comments-open'>{{}}</article>{FOOT}</body></html>",
    "body": "<html><body>{}</body></html>",
    "div": "<html><body><div>{}</div></body></html>",
    "heading": "<html><body><h1>The title of it</h1>{}</body></html>",
    "furniture": f"<html><body>{MENU}<div>{{}}</div>{FOOT}</body></html>",
    "furniture alone": f"<html><body>{MENU}{{}}{FOOT}</body></html>",
    "nothing": "{}",
}


@pytest.mark.parametrize("end", [".", " spring. [3]", ""])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_keeps_whole_articles(layout, end):
    """Every paragraph, however few, under any outer names and beside any furniture; and no furniture."""
    model = html_extract.trained()
    for n in (1, 3, 8):
        own = [f"The quick river carried old letters past seven quiet houses and into the warm spring morning light {i}{end}" for i in range(n)]
        text = html_extract.main_text(LAYOUTS[layout].format("".join(f"<p>{p}</p>" for p in own)), model)
        assert all(p in text for p in own) and not any(x in text for x in ("About us", "Company"))


#: Pages with what a reader would call their main text, labelled by hand.
BY_HAND = [
    ("<body class='blog sidebar-left'><div id=top><a href=/>Tide Watch</a></div><div class=nav><a href=/1>Ports</a> <a href=/2>Charts</a></div><div class=post><h1>Why harbours silt up</h1><p>Rivers drop what they carry where the water slows.</p><p>Dredging only moves it.</p></div><div id=comments><h3>2 replies</h3><div class=comment><p>We saw that in our own harbour last year, every week of it.</p></div></div><div id=footer>&copy; Tide Watch</div></body>", "Why harbours silt up Rivers drop what they carry where the water slows. Dredging only moves it."),
    ("<!doctype html><html><body><header><a href='/'>Recipes</a></header><div class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>Accept</button></div><main><article><h1>Rye bread</h1><p>Mix the flour with warm water and leave it overnight.</p><ul><li>500 g of rye flour</li><li>a spoon of salt</li></ul><p>Bake it for an hour.</p></article></main><aside class='sidebar'><h3>Related</h3><ul><li><a href='/x'>Wheat bread</a></li><li><a href='/y'>Oat cakes</a></li></ul></aside></body></html>", "Rye bread Mix the flour with warm water and leave it overnight. 500 g of rye flour a spoon of salt Bake it for an hour."),
    ("<html><body><p>A page that someone wrote by hand in an afternoon, with nothing but two paragraphs.</p><p>This is the second of them, and it closes here.</p></body></html>", "A page that someone wrote by hand in an afternoon, with nothing but two paragraphs. This is the second of them, and it closes here."),
    ("<html><body><table><tr><td>The old way of laying out a page was a table, and its text stood in a cell.</td></tr></table></body></html>", "The old way of laying out a page was a table, and its text stood in a cell."),
]


def test_html_on_pages_labelled_by_hand():
    model = html_extract.trained()
    for page, text in BY_HAND:
        assert html_extract.main_text(page, model) == text


def test_html_deep_pages_take_linear_memory():
    for html in ("<div>" * 100_000 + "<p>text of it", "<div>a" * 30_000, "<p>a</b></i></x>" * 30_000):
        page = html_extract.Page(html)
        assert len(page.name) <= 100_002 and len(html_extract.features(page)) == len(page.blocks) > 0


def test_html_extract_edges(spark):
    """Null, empty, repeated and very long pages, extra columns that clash, text ids, an empty table."""
    long = "<article><p>" + "It goes on and on here, " * 50_000 + "</p></article>"
    rows = [("a", None, None, 1), ("b", "u", "", 1), (None, "v", BY_HAND[0][0], 1), (None, "v", BY_HAND[0][0], 1), ("c", "w", long, 1), ("d", "x", "<p>" * 5, 1)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, text int")
    got = html_extract.extract(pages)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or "", r.url or "", r.text, r.n_chars) for r in got.collect())
    assert found == sorted([("a", "", "", 0), ("b", "u", "", 0), *[("", "v", BY_HAND[0][1], len(BY_HAND[0][1]))] * 2, ("c", "w", ("It goes on and on here, " * 50_000).strip(), 24 * 50_000 - 1), ("d", "x", "", 0)])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_decoding_is_optimal():
    from itertools import product

    rng = np.random.default_rng(0)
    m = html_extract.Crf()
    m.w, m.t, m.s = rng.normal(size=m.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    x = rng.normal(size=(6, len(m.w)))
    score = lambda y: m.s[y[0]] + sum((x[i] @ m.w)[y[i]] for i in range(6)) + sum(m.t[a, b] for a, b in zip(y, y[1:], strict=False))
    assert tuple(m.decode(x)) == max(product((0, 1), repeat=6), key=score)


def test_mixing(spark, edge):
    rows = [(i, f"s{i % 3}" if i % 10 else None, (i * 37) % 90 + 1) for i in range(900)] + [(5, "s1", 40), (5, "s1", 40)] + [(None, "s2", 7)] * 50 + [(None, "s2", 8)]
    df = spark.createDataFrame([(*r, k // 3) for k, r in enumerate(rows)], "doc_id long, source string, size long, target long")
    plan = lambda d: [(*r.row, r.source_size, r.target, r.copies) for r in mixing.plan_mix(d).collect()]
    got = plan(df)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([r[:3] for r in got], key=key) == sorted(rows, key=key)
    total = sum(n for _, _, n in rows)
    targets = {r[1]: (r[5], r[4]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    for s, (t, n) in targets.items():
        assert t <= 3 * n + 1e-9 and abs(sum(r[6] * r[2] for r in got if r[1] == s) - t) <= 200
    assert max(r[6] for r in got) <= 3
    assert sorted(got, key=key) == sorted(plan(df.repartition(7)), key=key)
    taken = mixing.emit(mixing.plan_mix(df))
    assert taken.count() == sum(r[6] for r in got) and taken.select("row.*").columns == df.columns
    sized = edge.withColumn("size", mixing.word_count("text"))
    assert mixing.plan_mix(sized).count() == len(EDGE) and mixing.plan_mix(sized.limit(0)).count() == 0
    assert mixing.plan_mix(sized.where("size = 0")).where("copies > 0").count() == 0
    named = df.where("doc_id < 60").select(F.concat(F.lit("id-"), "doc_id").alias("doc_id"), "source", "size")
    assert mixing.plan_mix(named).select("row.doc_id").distinct().count() == 60


def spelled_alone(net, word):
    """Log-probability of a word's bytes, one by one."""
    code, total = [256, 256, *word.encode(), 256], 0.0
    for one, two, x in zip(code[1:], code, code[2:], strict=False):
        total += net.spelled[((two * 257 + one) * 0x9E3779B1 & 0xFFFFFFFF) >> 20, x]
    return total


def brute_lm(net, texts):
    """Scores of texts that are the whole corpus: the network word by word, and runs in dictionaries."""
    emb, w1, b1, wg, bg, wp, bp = (w.astype(float) for w in net.weights)
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    by_text = []
    for t in texts:
        found = re.findall(r"\w+|[^\w\s]", (t or "").lower())
        ids = [int(x) for x in net.classes(found)[0]]
        spelled = [np.float16(min(0.0, spelled_alone(net, w) + np.log(63)) if i <= 63 else 0) for w, i in zip(found, ids, strict=True)]
        padded, runs, now = [0, 0, *ids, 0, 0], [], []
        for k, i in enumerate(ids):
            h = np.tanh(np.concatenate([emb[padded[k + d]] for d in (0, 1, 3, 4)]) @ w1 + b1)
            g, p = divmod(i, 64)
            a, b = h @ wg + bg, h @ wp + bp[g]
            log_p = a[g] - np.log(np.exp(a).sum()) + b[p] - np.log(np.exp(b).sum()) + float(spelled[k])
            word = mix(i << 16 | (int(spelled[k].view(np.uint16)) if i <= 63 else 0))
            if now and mix((now[-1][0] + 3 * word) & mask) % lm_score.RUN == 0:
                runs.append(now)
                now = []
            now.append((word, log_p))
        by_text.append([*runs, now] if now else runs)
    keys = [[tuple(w for w, _ in r) for r in rs] for rs in by_text]
    every = Counter(k for ks in keys for k in ks)
    out = []
    for rs, ks in zip(by_text, keys, strict=True):
        own = Counter(ks)
        net_p = [sum(p for _, p in r) for r in rs]
        out.append(sum(np.logaddexp(np.log(0.9) + p, np.log(0.1 * (every[k] - own[k]) / sum(every.values()))) if every[k] > own[k] else np.log(0.9) + p for k, p in zip(ks, net_p, strict=True)))
    return out


def test_lm_scores_are_those_of_brute_force(spark, edge):
    net = lm_score.Net([(f"w{k}", 50 - k) for k in range(50)], 3000, seed=1)
    base = [" ".join(f"w{(k * k + j) % 70}" for j in range(40)) for k in range(6)]
    rows = [None, "", "Zoë, w1!", *base, base[0], base[1] + " w1 w2 w3", "w1 " * 60]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("row", F.lit("x"))
    got = {r.doc_id: (r.n_words, r.log_likelihood, r.mean_log_p) for r in lm_score.score_documents(docs, net).collect()}
    want = brute_lm(net, rows)
    for i, t in enumerate(rows):
        n = len(lm_score.words(t))
        assert got[i][0] == n and got[i][1] == pytest.approx(want[i], rel=1e-3, abs=1e-6)
        assert got[i][2] is None if n == 0 else got[i][2] == pytest.approx(want[i] / n, rel=1e-3)
    assert got[3][1] > got[5][1] / 2  # a text that stands twice scores far better than one that stands once
    assert lm_score.score_documents(edge, net).count() == len(EDGE) and lm_score.score_documents(edge.limit(0)).count() == 0


def test_lm_classes_and_spelling(spark):
    """Spellings are a distribution, counted over all words outside the vocabulary, and junk is less likely."""
    counts = spark.createDataFrame([("banana", 5), ("bandana", 2), ("é", 1)], "word string, n long")
    table = lm_score.spelling(counts)
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-5)
    net = lm_score.Net([("the", 10)], 20, table)
    cls, spelled = net.classes(["the", "banana", "zzxqzz", "the"])
    assert cls[0] == cls[3] == 64 and spelled[0] == spelled[3] == 0 and spelled[2] < spelled[1] < 0
    assert spelled[1] == pytest.approx(spelled_alone(net, "banana") + np.log(63), rel=1e-5)
    assert np.exp(net.weights[4]).sum() == pytest.approx(1, abs=1e-4) and np.allclose(np.exp(net.weights[6]).sum(axis=1), 1, atol=1e-4)


def test_lm_training_follows_the_gradient():
    """One step is the numerical gradient of the mean log-probability."""
    net = lm_score.Net([(f"w{k}", 5) for k in range(200)], 1000, seed=3)
    net.weights = [w.astype(np.float64) for w in net.weights]
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, 260, (30, 4)), rng.integers(1, 260, 30)
    before = [w.copy() for w in net.weights]
    net.learn(around, target, 1.0)
    step = [a - b for a, b in zip(net.weights, before, strict=True)]
    for k in range(len(before)):
        at = np.unravel_index(np.abs(step[k]).argmax(), step[k].shape)
        both = []
        for d in (1e-5, -1e-5):
            net.weights = [w.copy() for w in before]
            net.weights[k][at] += d
            both.append(net.log_p(around, target).mean())
        assert step[k][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-3)


def test_lm_training_does_not_hang_on_partitions(spark):
    """All rows train, null and repeated ids too, alike under any partitioning, and order is learned."""
    rng = random.Random(2)
    rows = [(i if i % 7 else None, " ".join(["a b c d", "e f g h"][rng.random() < 0.5] for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    nets = []
    for d in (docs.repartition(1), docs.repartition(5)):
        net, total = lm_score.vocabulary(d)
        start = [w.copy() for w in net.weights]
        nets.append(lm_score.train(lm_score.encode(d, net, "doc_id", "text"), net, total, shard_words=3000))
    assert total == sum(len(t.split()) for _, t in rows + rows[:9]) and len(net.index) == 8
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(nets[0].weights, nets[1].weights, strict=True))
    assert not np.allclose(start[0], net.weights[0])
    p = lambda net, t: lm_score.score_texts(net, [net.classes(t.split())[0].tobytes()], [b""])[0][0]
    assert p(net, "a b c d a b c d") > p(net, "d a c b b d a c")


def test_warc_round_trip_and_salvage(spark):
    big = "<p>é" * 60
    pages = [(3, "http://a/ b", big), (1, None, big), (2, "u", None), (4, "v", "x"), (5, "w", "x"), (1, None, big), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit("x"))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    n = len(big.encode())
    assert got == {(3, n, "revisit", 1), (1, n, "response", None), (2, 0, "response", None), (4, 1, "response", None), (5, 1, "response", None), (None, n, "revisit", 1)}
    assert warc.round_trip(df.limit(0)).count() == 0
    odd = "a\r\nb: é/%41"
    named = spark.createDataFrame([(odd, "u", big), ("b", "u", big), ("", "u", "y" * 3_000_000)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(named).collect()} == {(odd, None), ("b", odd), ("", None)}
    for compress in (True, False):
        made = [warc.record(i, "u", f"{i} body ".encode() * 50, warc.sha256(f"{i} body ".encode() * 50).hexdigest(), False, None) for i in range(5)]
        made = [warc.member(m) for m in made] if compress else made
        data = bytearray(b"".join(made))
        hurt = len(made[0]) + len(made[1]) - 60
        data[hurt : hurt + 9] = b"\xff" * 9
        data += made[0][: len(made[0]) // 2]
        parts = list(warc.salvage(bytes(data)))
        assert [p[0] for p in parts] == ["record", "gap", "record", "record", "record", "gap"]
        assert [p[3]["warc-page-id"] for p in parts if p[0] == "record"] == ["0", "2", "3", "4"]
        assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(data)
    path = new_path(spark, "test")
    files = warc.write_archives(warc.with_revisits(df), path, rotate=100)
    assert files.count() > 1 and warc.archive_files(spark, path).count() == files.count()


class Sliced:
    """A file that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_reads_many_members_in_linear_work(compress):
    """Thousands of records, some damaged: all the others come back, and bytes are read about once."""
    rng, whole, hurt = random.Random(1), [], set(range(5, 3000, 250))
    for i in range(3000):
        body = rng.randbytes(700)
        one = warc.record(i, "u", body, warc.sha256(body).hexdigest(), False, None)
        one = bytearray(warc.member(one) if compress else one)
        if i in hurt:
            one[len(one) // 2] ^= 0x5A
        whole.append(bytes(one))
    data = b"".join(whole)
    file = Sliced(data)
    parts = list(warc.salvage(warc.Source(file, len(data))))
    assert [int(p[3]["warc-page-id"]) for p in parts if p[0] == "record"] == [i for i in range(3000) if i not in hurt]
    assert sum(p[0] == "gap" for p in parts) == len(hurt) and sum(p[2] - p[1] for p in parts) == len(data)
    assert file.read < 20 * len(data)


def test_warc_nested_record_and_strict_read(spark, tmp_path):
    inner = warc.record(7, "in", b"inner", warc.sha256(b"inner").hexdigest(), False, None)
    outer = warc.record(8, "out", b"xx" + inner, "0" * 64, False, None)
    parts = list(warc.salvage(outer))
    assert [(p[0], p[3]["warc-page-id"] if p[0] == "record" else None) for p in parts] == [("gap", None), ("record", "7"), ("gap", None)]
    (tmp_path / "a.warc").write_bytes(outer)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc", 1)], "path string, records long")
    read = warc.read_archives(files).collect()
    assert [r.kind for r in sorted(read, key=lambda r: r.begin)] == ["gap", "record", "gap"] and all(r.reason for r in read if r.kind == "gap")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(files, strict=True).collect()


def test_licenses(spark, edge):
    docs = [(1, None), (2, "All rights, RESERVED. cc-by 4.0 and CC BY"), (3, "Released under the MIT License."), (4, "released under an mit license"), (5, "Licensed under CC BY-NC 4.0. x"), (6, "GNU General Public License")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (10, 3, 0, 8, "cc-by,reserved")
    assert got[3].labels == "mit" and got[3].base_labels == "" and got[4].labels == ""
    assert got[5].labels == "cc-by,cc-by-nc" and got[6].labels == "gpl" and got[1].score == 0 and got[1].first_word is None
    a = licenses.Automaton("x", "a b [[c d]] e {{2}} f")
    assert [a.match(t.split(), 0) for t in ("a b e f", "a b c d e x y f", "a b c e f", "a b e x y z f")] == [4, 8, -1, -1]
    assert licenses.scan_licenses(edge).count() == len(EDGE)
    assert licenses.scan_licenses(edge.limit(0)).count() == 0


def brute_template(template, words, at):
    """All ends of a template read from `at`, by trying every choice."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", template)

    def go(k, ends):
        while k < len(parts):
            p = parts[k]
            if p == "[[":
                skipped = set(ends)
                ends, k = go(k + 1, ends)
                ends |= skipped
            elif p == "]]":
                return ends, k + 1
            elif p.startswith("{{"):
                ends, k = {e + j for e in ends for j in range(int(p[2:-2]) + 1) if e + j <= len(words)}, k + 1
            else:
                own = WORDS.findall(p.lower())
                ends, k = {e + len(own) for e in ends if words[e : e + len(own)] == own}, k + 1
        return ends, k

    return max(go(0, {at})[0], default=-1)


def test_license_automata_accept_what_brute_force_accepts():
    """Every template: its own wording with options in, out, filled, and with one word changed."""
    rng, scan = random.Random(1), licenses.scanner(tuple(licenses.BASE.items()), licenses.TEMPLATES)
    for label, template in licenses.TEMPLATES:
        plain = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(["who"] * rng.randint(0, int(m[1]))), template)
        for text in (re.sub(r"\[\[|\]\]", " ", plain), re.sub(r"\[\[[^\[\]]*\]\]", " ", plain)):
            words = WORDS.findall(text.lower())
            assert label in {f[2] for f in scan.scan(f"Copyright someone. {text} And more.")["found"]}
            for k in [None, *rng.sample(range(len(words)), min(6, len(words)))]:
                changed = [w if i != k else "changed" for i, w in enumerate(words)]
                assert licenses.Automaton(label, template).match(changed, 0) == brute_template(template, changed, 0)


def brute_components(rows, k):
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in fps:
        for b, y in fps:
            if (x ^ y).bit_count() <= k:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (f"{f:016x}", find(i)) for i, f in fps}


def shingles(text, size=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def copies_of(docs):
    rows, groups = simhash.near_copies(docs)
    return rows.join(groups, "key").select("row.*", "key", "component")


def test_near_copies(spark):
    """Copies at a similarity of 0.8 or more are found, all others are left alone."""
    rng, rows = random.Random(8), []
    for t in [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(150)]:
        far, near = t.split(), t.split()
        for at in rng.sample(range(200), 3):
            near[at] = "changed"
        for at in rng.sample(range(200), 6):
            far[at] = "other"
        rows += [t, t, " ".join(near), " ".join(far)]
    rows += [None, "", " ", "a b", "A B"]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(rows)], "component long, at long, text string").withColumn("fp", F.lit("clash"))
    found = copies_of(df.drop("component")).collect()
    comp = {r.at: r.component for r in found}
    assert len(comp) == len(rows) and {r.fp for r in found} == {"clash"}
    sets = [shingles(t) for t in rows]
    group = {}
    for k, c in comp.items():
        group.setdefault(c, []).append(k)
    together = lambda i, j: comp[i] == comp[j]
    assert all(together(i, i + 1) for i in range(0, 600, 4))
    pairs = [(i, j) for i in range(0, 600, 4) for j in (i + 2, i + 3)] + [(i + 2, i + 3) for i in range(0, 600, 4)]
    near = [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    assert 100 < len(near) < len(pairs) and sum(together(*p) for p in near) >= 0.97 * len(near)
    for members in group.values():  # every group hangs together by links of at least 0.8
        seen, todo = {members[0]}, [members[0]]
        while todo:
            i = todo.pop()
            new = [j for j in members if j not in seen and jaccard(sets[i], sets[j]) >= 0.8]
            seen.update(new)
            todo += new
        assert len(seen) == len(members)
    assert together(600, 601) and together(601, 602) and together(603, 604) and not together(602, 603)
    assert copies_of(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y z"), (None, "p q r"), (4, "x y z"), (4, "x y z")], "key long, text string")
    rows, groups = simhash.near_copies(odd)
    assert sorted(r["count"] for r in groups.groupBy("component").count().collect()) == [1, 3] and rows.select("row.key").count() == 4


def test_near_copies_leave_out_no_link(spark):
    """Pairs barely at the threshold, short and long, among texts that share a passage: exactly the brute-force components."""
    rng, rows = random.Random(18), []
    common = " ".join(f"c{i}" for i in range(30))
    for _ in range(900):
        n = rng.choice((24, 49, 120))
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        cut = rng.randint(1, max(1, n // 9))
        rows += [" ".join(words), " ".join(words[cut:] + [f"x{rng.randrange(10**6)}" for _ in range(cut - rng.randint(0, cut))])]
        rows.append(common + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.choice((3, 9, 40)))))
    sets = [shingles(t) for t in rows]
    having, root = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, j in {(h[0], j) for h in having.values() for j in h[1:]} | {(i, j) for i in range(2, len(rows), 3) for j in range(i + 3, len(rows), 3)}:
        if jaccard(sets[i], sets[j]) >= 0.8:
            links += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert links > 600
    found = copies_of(spark.createDataFrame(list(enumerate(rows)), "at long, text string")).collect()
    least = {}
    for r in sorted(found, key=lambda r: r.at):
        least.setdefault(r.component, r.at)
    assert [least[r.component] for r in sorted(found, key=lambda r: r.at)] == [find(i) for i in range(len(rows))]


def test_rows_of_one_root_make_no_pairs():
    """Groups already united name no pair again; a row of another root in their bucket does."""
    rng = np.random.default_rng(3)
    words = np.full((500, 4), 12345, np.int64) ^ (np.int64(1) << rng.integers(0, 50, (500, 4)))
    words[499] = words[0]
    for root, most in ((np.zeros(500, np.int64), 0), (np.r_[np.zeros(499, np.int64), 499], 3)):
        cols = [np.zeros(500, np.int64), np.zeros(500, np.int64), words[:, 0], np.arange(500), *words[:, 1:].T, root]
        batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=list("ckfrabcd"))
        got = [x for b in simhash._bucket_links(20, (14, 28, 56))([batch]) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert len(got) <= most and bool(got) == bool(most) and all(499 in p for p in got)
        cols = [np.repeat([7, 8], 250), root, np.arange(500), np.full(500, 10), np.zeros(500, np.int64)]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=list("trpna"))
        got = [x for b in simhash._across(0.8)([batch]) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert got == ([(i, 499) for i in range(250, 499)] if most else [])


def test_trie_join_takes_equal_first_words():
    """Many fingerprints equal in their first word: the closest are still noted, in bounded time."""
    rng = np.random.default_rng(2)
    fp = np.repeat(np.array([5, 9], np.uint64), 300)
    more = np.concatenate([np.repeat(rng.integers(0, 2**63, (1, 3), dtype=np.uint64), 300, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (300, 3), dtype=np.uint64)) for _ in range(2)])
    forest, found = simhash.Forest(600), simhash.Found(True)
    label = simhash.trie_join(fp, np.array([0, 600]), 10, more, 12, forest, found)
    assert (label[:300] == 0).all() and (label[300:] == 300).all()
    assert sum(map(len, found.i)) < 3000
    dist = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(more[i] ^ more[j]).sum(axis=1)
    assert all((dist(i, j) <= 12).all() for i, j in zip(found.i, found.j, strict=True))


def test_wide_trie_join_links_what_brute_force_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    words = np.concatenate([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (12, 200, 4), dtype=np.uint64), axis=0) ^ b for b in base])
    words = words[np.unique(words[:, 0], return_index=True)[1]]
    dist = np.bitwise_count(words[:, None] ^ words[None]).astype(int)
    for k, k_all in [(16, 70), (16, 62), (12, 60), (64, 56)]:
        hit = (dist[:, :, 0] <= k) & (dist.sum(axis=2) <= k_all)
        want = np.arange(len(words))
        for _ in range(len(words)):
            want = np.array([want[h].min() for h in hit])
        label = simhash.trie_join(words[:, 0].copy(), np.array([0, len(words)]), k, words[:, 1:].copy(), k_all)
        assert 3 <= len(set(want)) < len(words) and (label == want).all()


@pytest.mark.parametrize("k", [1, 4])
def test_simhash(spark, k):
    base = texts(80, 5)
    rows = list(enumerate([t for x in base for t in (x, x, x + " more", "start " + x)] + [None, "", " "]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, k=k).collect()}
    assert got == brute_components(rows, k)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_trie_join_links_what_brute_force_links():
    rng = np.random.default_rng(4)
    near = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([n ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for n in near]))
    label = simhash.trie_join(fp, np.array([0, len(fp)]), 3)
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([want[np.bitwise_count(fp ^ x) <= 3].min() for x in fp])
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


def test_langid(spark, edge):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model, carry=("doc_id", "lang")).where(langid.held_out("row.doc_id")).collect()
    assert sum(r.row.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert model.predict([None, "", "123 !?"]) == (["und"] * 3, [0.0] * 3)
    clash = edge.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(2))
    assert langid.identify(clash, model, carry=("text", "lang_pred", "score")).where("row.lang_pred = 'x' and lang_pred <> 'x'").count() == len(EDGE)
    assert langid.identify(edge, langid.train(edge.limit(0))).where("lang_pred = 'und'").count() == len(EDGE)
    assert langid.identify(edge.limit(0), model).count() == 0


def one_bucket(gram):
    """The bucket of one n-gram in plain integers."""
    h = 0
    for c in gram:
        h = (h + ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
    x = (h + len(gram) * 0x85EBCA6B) & 0xFFFFFFFF
    x ^= x >> 15
    return ((x * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - langid.BITS)


def grams_of(text):
    low = " " + re.sub(r"[^a-zà-ÿ]+", " ", text.lower()).strip() + " " if text else " "
    return [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if low[i : i + n] != " "]


def test_langid_is_naive_bayes(spark):
    """Against counts in a dictionary, with repeated rows and more languages than a block holds."""
    rng = random.Random(5)
    names = [f"l{k:03d}" for k in range(150)]
    letters = "abcdefghijklmnopqrstuvwxyzàéü"
    own = {n: rng.sample(letters, 5) for n in names}
    rows = [(i, " ".join("".join(rng.choices(own[n], k=4)) for _ in range(6)), n) for i, n in enumerate(names * 4)]
    rows += rows[:30] + [(9999, "abc", None), (10000, None, "l000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from math import log
    from zlib import crc32

    model = langid.train(docs)
    assert len(model.langs) == 150 and len(model.blocks) == 3
    learn = [(t, n) for i, t, n in rows if crc32(str(i).encode()) % 5 and n and t is not None]
    counts, docs_of = {n: Counter() for n in names}, Counter(n for _, n in learn)
    for t, n in learn:
        counts[n].update(map(one_bucket, grams_of(t)))
    size = 1 << langid.BITS
    sums = {n: sum(c.values()) + 0.1 * size for n, c in counts.items()}
    got = {(r.row.doc_id, r.row.text): (r.lang_pred, r.score) for r in langid.identify(docs, model, carry=("doc_id", "text")).collect()}
    for i, t, _ in rows[:60]:
        buckets = [one_bucket(g) for g in grams_of(t)]
        score = {n: log(docs_of[n] / len(learn)) + sum(log((counts[n][b] + 0.1) / sums[n]) for b in buckets) for n in docs_of}
        best = max(score, key=score.get)
        post = 1 / sum(np.exp(s - score[best]) for s in score.values())
        assert got[i, t][0] == best and got[i, t][1] == pytest.approx(post, abs=1e-3)


def brute_stats(text):
    text, w = text or "", re.findall("[^\x20\x09-\x0d]+", text or "")
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, edge):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    extra = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate([None, "", "a b a b a b", "x\nx\n\nx", "#$ | \x0b\x0c y", "a a a"], 10**6)], docs.schema)
    both = docs.unionByName(extra)
    got = {r.doc_id: r for r in quality.judge(both).collect()}
    for r in both.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_stats(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.base_failed and g.kept)
    assert quality.keep(both).count() == sum(g.kept for g in got.values())
    assert quality.judge(edge).count() == len(EDGE) and quality.judge(docs.limit(0)).count() == 0
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    sound = [g.kept for i, g in got.items() if lab.get(i) == 1 and not g.base_failed]
    assert sum(sound) / len(sound) > 0.97


def feature_rows(spark, groups):
    """Rows as `fit` takes them, of given vectors, with the sampling variances of a long text."""
    rows = [(g, "", False, *map(float, x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "lg string, sc string, base_failed boolean, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    return df.withColumns({v: F.lit(1e-4) for v in quality.NOISE})


def numpy_mcd(x, floor, h=0.5, starts=300, seed=0):
    """Least log-determinant over random starts, concentrated to the end."""
    rng, n = np.random.default_rng(seed), len(x)
    k, best = int(np.ceil(h * n)), (np.inf, None, None)
    for _ in range(starts):
        pick = rng.choice(n, 6, replace=False)
        for _ in range(60):
            m, c = x[pick].mean(axis=0), np.cov(x[pick].T, bias=True) + floor * np.eye(x.shape[1])
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:k]
            if set(new) == set(pick):
                break
            pick = new
        best = min(best, (np.linalg.slogdet(c)[1], tuple(m), c.tobytes()))
    return best[0], np.array(best[1])


def test_quality_mcd_is_that_of_numpy(spark):
    """Correlated groups with up to 40 % junk in one place: least determinant and centre as in NumPy."""
    rng = np.random.default_rng(3)
    groups = {}
    for name, n, bad in (("a", 60, 0.4), ("b", 200, 0.3), ("c", 80, 0.0)):
        mix = rng.normal(size=(4, 4)) * 0.2 + np.eye(4)
        good = rng.normal(size=(n - int(bad * n), 4)) @ mix
        groups[name] = np.concatenate([good, rng.normal(size=(int(bad * n), 4)) * 0.3 + [9, 7, -8, 9]])
    stats = feature_rows(spark, groups)
    names = quality._groups(stats)
    rows = stats.join(names, ["lg", "sc"]).select("g", "lg", F.lit(0).cast("long").alias("salt"), *quality.FEATURES)
    floors = names.select("g", *[F.lit(1e-4).alias(f"f_{i}") for i in range(4)])
    parts = names.select("g", F.lit(0).cast("long").alias("salt"))
    group_of = {r.lg: r.g for r in names.collect()}
    got = {r.g: r for r in quality.mcd(rows.drop("lg"), floors, parts).collect()}
    for name, x in groups.items():
        r = got[group_of[name]]
        least, centre = numpy_mcd(x, 1e-4)
        assert r.log_det == pytest.approx(least, abs=0.45)
        assert np.allclose([r[f"m_{i}"] for i in range(4)], centre, atol=0.5)


def test_quality_each_feature_alone_can_reject(spark):
    """In a tight group a row that is far in one statistic only is rejected, and the rest are kept."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [0.03, 0.01, 0.03, 0.03] + [1.6, 0.05, 0.1, 0.1]
    x[4:120] += [0.5, 0, 0, 0]  # more than a quarter is junk of one kind
    x[:4] = [1.601, 0.05, 0.1, 0.1] + np.diag([0.3, 0.2, 0.4, 0.4]) + np.arange(4)[:, None] * 1e-6
    stats = feature_rows(spark, {"en": x})
    kept = {r.x_len: r.kept for r in quality.apply(stats, quality.fit(stats)).collect()}
    assert not any(kept[v] for v in x[:120, 0]) and sum(kept[v] for v in x[120:, 0]) >= 275
    assert quality.chi2_quantile(0.5) == pytest.approx(quality.CHI2_MEDIAN, abs=1e-5)
    assert quality.chi2_quantile(0.025) == pytest.approx(11.1433, abs=1e-3)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    clean = p.decontaminate(spark, docs, TINY)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not brute_hits(r.text, items)[1]}
    one = {r.doc_id for r in p.near_duplicates(spark, docs, TINY).collect()}
    assert one == {r.least for r in copies_of(docs).groupBy("component").agg(F.min("doc_id").alias("least")).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    far = [i for i, s in sets.items() if all(jaccard(s, t) < 0.8 for j, t in sets.items() if i != j)]
    assert far and set(far) <= one  # documents without a near copy stay
    assert p.mix(spark, clean, TINY).where(F.col("copy") >= 3).count() == 0


def test_rows_are_chosen_by_key_without_a_shuffle(spark):
    """Keys of any partition, none, and all; the plan of the rows holds no exchange."""
    from hazelogic.llm.common import chosen, materialise

    rows = materialise(spark.range(0, 500, numPartitions=7).select(F.col("id").cast("string").alias("t"), F.monotonically_increasing_id().alias("key")), "test")
    for want in (F.col("t").cast("int") % 3 == 0, F.lit(False), F.lit(True)):
        got = chosen(rows, rows.where(want).select("key"), "test-keys")
        assert sorted(got.collect()) == sorted(rows.where(want).collect())
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert chosen(rows.limit(0), rows.select("key"), "test-keys").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_one_row_of_each_group_of_near_copies(spark):
    """Repeated rows, one id with two texts, and null ids: each group of rows keeps exactly one."""
    import corpus_pipeline as p

    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, c), (None, d), (None, e), (None, e), (4, b), (7, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], COLUMNS)
    for parts in (1, 3):
        kept = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs.repartition(parts), TINY).collect()]
        assert sorted(kept, key=lambda r: r[1] or "") == [(7, None), (1, a), (2, b), (2, c), (None, d), (None, e)]
    assert p.near_duplicates(spark, docs.limit(0), TINY).count() == 0


def test_pipeline_stages_take_nulls_repeats_and_extra_columns(spark):
    """Every stage over odd rows: defined results, the columns of documents, nothing from an empty table."""
    import corpus_pipeline as p

    fine = spark.read.parquet(f"{TINY}/documents.parquet")
    odd = spark.createDataFrame([(None, "eins zwei drei", None, None, None), (None, None, None, None, None), (5, "", "xx", None, 0), (5, "", "xx", None, 0), (6, "a" * 100_000, None, "s", 1), (7, "12 34 !", None, "s", 1)], COLUMNS)
    docs = fine.unionByName(odd).unionByName(odd).withColumns({c: F.lit(1) for c in ("score", "row", "items", "target", "key", "size", "lang_pred")})
    n = docs.count()
    for name, stage in p.STAGES:
        out = stage(spark, docs, TINY)
        assert out.columns[:5] == fine.columns and stage(spark, docs.limit(0), TINY).count() == 0
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "language ID":
            assert out.columns == fine.columns and (5, "") not in got and (None, None) not in got and (7, "12 34 !") not in got
        elif name == "quality rules":
            assert (5, "") not in got and not any(i is None for i, _ in got)
        elif name == "benchmark decontamination":
            assert got[5, ""] == 4 and got[None, None] == 2 and sum(got.values()) <= n
        elif name == "SimHash near-dedup":
            assert max(got.values()) == 1 and got[5, ""] == 1 and (None, "eins zwei drei") in got
