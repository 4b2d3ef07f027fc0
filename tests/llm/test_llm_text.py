"""Text kernels, byte-pair encoding, language models and classifiers against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quiverseq.llm import bpe, hmm, quality, spotsigs, urlfilter
from quiverseq.llm.textkernels import Words, distinct, shingles, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_shingles(text, k):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_words_and_shingles_against_brute_force():
    random.seed(1)
    known = {}
    for _ in range(150):
        texts = ["".join(random.choice(["a", "B", "cd", " ", "  ", "\n", "é", "Z\x85", "\u3000"]) for _ in range(random.randint(0, 12))) for _ in range(random.randint(0, 9))] + [None, ""]
        words = Words(*text_bytes(pa.array(texts, pa.string())))
        for k in (1, 3, 5):
            row, h = distinct(*shingles(words, k))
            for i, text in enumerate(texts):
                expected = brute_shingles(text or "", k)
                assert (row == i).sum() == len(expected)
                if len(expected) == 1:
                    assert known.setdefault((k, next(iter(expected))), int(h[row == i][0])) == int(h[row == i][0])
    by_k = {}
    for (k, _), value in known.items():
        assert value not in by_k.setdefault(k, set())
        by_k[k].add(value)


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_tree_encoding_equals_the_encoder_on_whole_texts(coder):
    random.seed(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "'s", "'", "\u3000", "\xa0", "😀", "中文", "\x1c", "\x85", "the", "ing", "!!", " \n ", "'ll", "\r\n"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 60)))
        ids = bpe.encode_tree(text, coder.encode_ordinary, leaf=random.choice([1, 2, 3, 5, 9]))
        assert ids == coder.encode_ordinary(text)
        assert bpe.decode_tree(ids, coder.decode_bytes, leaf=3) == text.encode()


def test_tree_encoding_of_long_texts(coder):
    for text in ("x" * 3000, " " * 3000, "ab " * 2000, "x" * 1000 + " y" * 500 + "\n" * 700):
        assert bpe.encode_tree(text, coder.encode_ordinary, leaf=50) == coder.encode_ordinary(text)


def brute_likelihood(model, seq):
    a = model.start * model.emit[seq[0]]
    for s in seq[1:]:
        a = (a @ model.move) * model.emit[s]
    return math.log(a.sum())


def test_hidden_markov_likelihoods_are_exact(monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 9)
    monkeypatch.setattr(hmm, "CHUNK", 4)
    rng = np.random.default_rng(3)
    model = hmm.random_start(np.ones(5) / 5, 3)
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 9, 10, 11, 12, 37, 8, 16)]
    assert np.allclose(hmm.log_likelihoods(model, seqs), [brute_likelihood(model, s) for s in seqs], atol=1e-9)


def test_expected_counts_against_enumeration(monkeypatch):
    monkeypatch.setattr(hmm, "WINDOW", 4)
    from itertools import product

    rng = np.random.default_rng(4)
    model = hmm.random_start(np.ones(4) / 4, 2)
    seq = rng.integers(0, 4, 3)
    first, pairs, seen, likelihood = hmm.expected(model, *hmm.windows([seq], 4), 4)
    f, p, s, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in product(range(2), repeat=3):
        w = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in (1, 2):
            w *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += w
        f[path[0]] += w
        for t in range(3):
            s[seq[t], path[t]] += w
        for t in (1, 2):
            p[path[t - 1], path[t]] += w
    assert np.allclose(first, f / total, atol=1e-5) and np.allclose(pairs, p / total, atol=1e-5) and np.allclose(seen, s / total, atol=1e-5)
    assert likelihood == pytest.approx(math.log(total), abs=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    rows, leads = hmm.windows([np.where(rng.random(200) < 0.9, (i % 2) * 3 + rng.integers(0, 3, 200), 6) for i in range(40)], 7)
    unigram = np.bincount(rows[rows < 7].ravel(), minlength=7) / (rows < 7).sum()
    model, values = hmm.random_start(unigram, 2), []
    for _ in range(12):
        first, pairs, seen, value = hmm.expected(model, rows, leads, 7)
        values.append(value)
        model = model.reestimated(first, pairs, seen, unigram)
    assert all(b > a - 1 for a, b in zip(values, values[1:])) and values[-1] > values[0] + 100


def test_hmm_query_against_brute_counts(spark):
    from collections import Counter
    from zlib import crc32

    from quiverseq.llm.hmm import op9_hmm

    rows = op9_hmm(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    tokens = [[*WORD.findall(lowered(d["text"] or "")), None] for d in docs]
    held = [crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs]
    counts = Counter()
    for t, h in zip(tokens, held):
        counts.update([] if h else t)
    n, v = sum(counts.values()), len(counts)
    for r, t, h in zip(rows, tokens, held):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tail_and_head_sum_to_one():
    book = hmm.Symbols(np.array([1, 2], np.uint64), np.array([5, 3]), np.array([4, 3]), np.array([2, 2]), 2)
    assert book.unigram().sum() == pytest.approx(1)
    assert book.tokens == 17 and book.vocabulary == 7 and (book.tail, book.end) == (2, 4)
    for mass, counts in zip(book.tail_mass, ([3, 1, 0], [2, 1, 0])):
        assert sum((c + 0.5) / mass for c in counts) == pytest.approx(1)


def test_tail_classes_grow_and_hold_every_word(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [tuple(map(int, r)) for r in zip(rng.integers(-(2**63), 2**63, 700), rng.integers(1, 9, 700), rng.integers(0, 2**31, 700))]
    counts = spark.createDataFrame(rows, "h long, c long, k int").cache()
    for words, classes in ((700, 1), (64, 10), (32, 21), (1, 30)):
        monkeypatch.setattr(hmm, "CLASSES", 30)
        book = hmm.symbols(counts, 5, 20, words)
        assert len(book.tail_words) == classes and book.tail_words.sum() == 680 and book.tokens == sum(r[1] for r in rows) + 5
        code = book.coded(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[2] for r in rows]))
        assert sorted(code[code < book.tail]) == list(range(20)) and (np.bincount(code[code >= 20] - 20, minlength=classes) == book.tail_words).all()
        weights = np.bincount(code, weights=[r[1] for r in rows], minlength=book.end)
        assert (weights[:20] == book.counts).all() and (weights[20:] == book.tail_tokens).all()


def test_hmm_scores_against_brute_force(spark, monkeypatch):
    """The scores of whole texts: states emit head words or classes, and a class draws its word by its own count."""
    from collections import Counter

    models, train = [], hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda *a: models.append((train(*a), a[1])) or models[-1][0])
    random.seed(8)
    texts = [" ".join(random.choice("abcdefgh") * random.randint(1, 5) for _ in range(random.randint(0, 30))) for _ in range(30)] + ["new words only", ""]
    docs = spark.createDataFrame([(i, t, i % 5 == 1 or i >= 30) for i, t in enumerate(texts)], "doc_id int, text string, held_out boolean")
    rows = hmm.scored(docs, head=6, states=3, class_words=4).orderBy("doc_id").collect()
    model, book = models[0]
    counts = Counter(w for i, t in enumerate(texts) if not (i % 5 == 1 or i >= 30) for w in t.split())
    known = sorted({w for t in texts for w in t.split()})
    words = Words(*text_bytes(pa.array([" ".join(known)])))
    symbol = dict(zip(known, book.coded(words.hash, hmm.endings(words)).tolist()))
    assert len(book.tail_words) > 2
    for t, r in zip(texts, rows):
        seq = [symbol[w] for w in t.split()] + [book.end]
        drawn = sum(math.log10((counts[w] + 0.5) / book.tail_mass[symbol[w] - book.tail]) for w in t.split() if symbol[w] >= book.tail)
        assert r["score"] == pytest.approx(brute_likelihood(model, seq) / math.log(10) + drawn, abs=1e-6)


def test_markov_model_sums_to_one():
    model = urlfilter.MarkovModel([b"example/en", b"example/fr", b"a"], 3)
    for prefix in (b"", b"ex", b"zz", b"example/"):
        base = model.log_likelihoods([prefix])[0] if prefix else 0.0
        total = sum(math.exp(model.log_likelihoods([prefix + bytes([c])])[0] - base) for c in range(256))
        assert total == pytest.approx(1)


def test_url_ratio_tells_kinds_apart():
    good = [f"site{i}.org/articles/{i}".encode() for i in range(60)]
    bad = [f"cheap-pills{i}.biz/buy/{i}".encode() for i in range(60)]
    ratio = urlfilter.UrlRatio(good[:50], bad[:50])
    assert (ratio.score(good[50:]) >= 0).all() and (ratio.score(bad[50:]) < 0).all()
    assert ratio.balanced_accuracy == 1


def fits(rule, host, path):
    h, _, p = rule.partition("/")
    return (host == h or host.endswith("." + h)) and path.startswith("/" + p)


def test_url_rules_against_brute_force(spark):
    urls = ["https://A.Example.COM/en/1?x", "http://www.example.com/en/", "http://x.www.example.com/en/z", "http://notexample.com/en/", "https://b.net/es", "https://b.net/es/#t", "https://com/", "https://com", "https://com?/", "x", None, "", "://net/fr/", "a://b://com/fr/", "http://a.com:80/", "http://q.net/fr/\n/y"]
    rows = urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()
    for url, r in zip(urls, rows):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = re.search(r"[/?#]", rest)
            host, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
            path = re.split(r"[?#]", tail)[0]
        host = lowered(host)
        best = max((x for x in urlfilter.RULES if fits(x[1], host, path)), key=lambda x: len(x[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]), url
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")


def test_ordinal_regression_learns_order():
    rng = np.random.default_rng(6)
    n = 600
    grade = rng.integers(0, 3, n)
    row = np.repeat(np.arange(n), 4)
    slot = np.where(rng.random(4 * n) < 0.8, grade[row] * 10 + rng.integers(0, 10, 4 * n), 100 + rng.integers(0, 50, 4 * n))
    model = quality.fit(row[: 4 * 400], slot[: 4 * 400], np.zeros((400, quality.DENSE)), grade[:400], np.ones(400))
    assert (np.diff(model.thresholds) > 0).all()
    late = row >= 400
    tails = model.tails(model.linear(row[late] - 400, slot[late], np.zeros((200, quality.DENSE))))
    assert ((tails >= 0.5).sum(axis=1) == grade[400:]).mean() > 0.85
    assert (np.diff(tails, axis=1) <= 0).all()


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.trained(docs, quality.grades(labels.where("doc_id % 10 < 7")))
    rows = quality.rated(docs.join(labels.where("doc_id % 10 >= 7"), "doc_id"), model).collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [not r["keep"] for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.9 and sum(junk) / len(junk) > 0.8


def test_common_words_are_exact(spark):
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    counts = Counter(w for r in docs.collect() for w in WORD.findall(lowered(r[0] or "")))
    found = spotsigs.common_words(docs, 20)
    assert [c for _, _, c in found] == sorted(counts.values(), reverse=True)[:20]
    assert all(counts[w] == c for _, w, c in found)


def brute_signatures(text, anchors, chain=spotsigs.CHAIN):
    words = WORD.findall(lowered(text))
    out = set()
    for i, w in enumerate(words):
        follow = [x for x in words[i + 1 :] if x not in anchors][:chain]
        if w in anchors and follow:
            out.add((w, *follow))
    return out or ({tuple(words)} if words else set())


def test_signatures_against_brute_force():
    random.seed(7)
    anchors = {"a", "b"}
    hashes = np.sort(Words(*text_bytes(pa.array(["a b"]))).hash)
    for _ in range(200):
        texts = ["".join(random.choice(["a ", "b ", "c ", "d ", "é ", "A ", " "]) for _ in range(random.randint(0, 14))) for _ in range(5)]
        for text, got in zip(texts, spotsigs.signatures(pa.array(texts), hashes)):
            assert len(got) == len(brute_signatures(text, anchors))
    x, y = spotsigs.signatures(pa.array(["a c d b e f a g h", "a c d b e f a x y"]), hashes)
    assert spotsigs.likeness(x, y) == pytest.approx(0.5) and spotsigs.likeness(x, y, 0.6) == 0


def free_signatures(text, anchors, chain=spotsigs.CHAIN, least=15):
    """brute_signatures, and those of stretches without the start of a chain."""
    words = WORD.findall(lowered(text))
    out, stretch = set(), []
    for i, w in enumerate([*words, None]):
        follow = [x for x in words[i + 1 :] if x not in anchors][:chain]
        if w is None or w in anchors and follow:
            out |= {tuple(stretch[j : j + chain + 1]) for j in range(len(stretch) - chain)} if len(stretch) >= least else set()
            out |= {(w, *follow)} if w else set()
            stretch = []
        else:
            stretch.append(w)
    return out or ({tuple(words)} if words else set())


def test_texts_without_anchors_have_local_signatures():
    rng = random.Random(8)
    hashes = np.sort(Words(*text_bytes(pa.array(["a b"]))).hash)
    for _ in range(60):
        kinds = [rng.choice([["c", "d", "é"], ["a", "b"], ["w%d" % i for i in range(30)]]) for _ in range(rng.randint(0, 4))]
        texts = [" ".join(rng.choice(k) for k in kinds for _ in range(rng.choice([1, 3, 14, 15, 16, 40]))) for _ in range(4)] + [None, ""]
        for text, got in zip(texts, spotsigs.signatures(pa.array(texts), hashes)):
            assert len(got) == len(free_signatures(text or "", {"a", "b"}))
    for words in (["w%d" % i for i in range(200)], ["w%d%%%%" % i for i in range(200)], ["a", "b"] * 3 + ["w%d" % i for i in range(200)], ["a" if i * i % 7 == 2 else "b" for i in range(200)]):
        near = [*words[:100], "x", *words[101:]]
        x, y = spotsigs.signatures(pa.array([" ".join(words), " ".join(near)]), hashes)
        assert spotsigs.likeness(x, y) > 0.6


def test_near_copies_without_anchors_are_linked(spark):
    texts = [" ".join(f"{kind}{i}" for i in range(100)) for kind in "uv"]
    docs = [(0, texts[0]), (1, texts[0].replace("u50", "x")), (2, texts[1]), (3, texts[1].replace("v99", "%%%"))]
    anchors = Words(*text_bytes(pa.array(["a b"]))).hash.view(np.int64).tolist()
    rows = spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), anchors).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_training_counts_all_rows_until_it_settles(spark, monkeypatch):
    from pyspark.sql import functions as F

    steps, counts = [], hmm._counts_over
    monkeypatch.setattr(hmm, "_counts_over", lambda *a: steps.append(counts(*a)) or steps[-1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    rows = hmm.scored(docs).collect()
    tokens, gains = rows[0]["train_tokens"], [b[-1] - a[-1] for a, b in zip(steps, steps[1:])]
    assert all(seen.sum() == pytest.approx(tokens) and first.sum() == pytest.approx(docs.count()) for first, _, seen, _ in steps)
    assert steps[0][-1] < steps[-1][-1] and len(gains) > 3 and max(gains[-2:]) < hmm.SETTLED * tokens
    # No sequence of two small gains came before.
    assert all(max(pair) >= hmm.SETTLED * tokens for pair in zip(gains[:-2], gains[1:-1]))


def test_bpe_query_equals_the_library(spark, coder):
    from hashlib import sha256

    rows = {r["doc_id"]: r for r in bpe.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs) and any(len(d["text"] or "") > 4 * bpe.LEAF for d in docs)
    for d in docs:
        ids = coder.encode_ordinary(d["text"] or "")
        expected = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((d["text"] or "").encode()).hexdigest())
        assert (rows[d["doc_id"]]["n_tokens"], rows[d["doc_id"]]["ids_sha256"], rows[d["doc_id"]]["decoded_sha256"]) == expected


def test_lanes_hold_whole_texts_and_count_as_each_text_alone(monkeypatch):
    monkeypatch.setattr(hmm, "WINDOW", 12)
    monkeypatch.setattr(hmm, "LANES", 3)
    rng = np.random.default_rng(8)
    model = hmm.random_start(np.ones(5) / 5, 3)
    texts = [rng.integers(0, 5, n) for n in rng.integers(1, 13, 30)]
    together = hmm.expected(model, *hmm.windows(texts, 5), 5)
    alone = [hmm.expected(model, *hmm.windows([t], 5), 5) for t in texts]
    for i in range(4):
        assert np.allclose(together[i], sum(a[i] for a in alone), rtol=1e-4)
    assert together[3] == pytest.approx(sum(brute_likelihood(model, t) for t in texts), rel=1e-4)


def test_quality_follows_the_likelihood_and_its_maximum():
    """The fitted weights stand where the penalised likelihood, written out plainly, is flat."""
    rng = np.random.default_rng(10)
    n = 120
    grade = rng.integers(0, 3, n)
    row, slot = np.repeat(np.arange(n), 2), rng.integers(0, 6, 2 * n)
    slot[::2] = np.where(rng.random(n) < 0.6, grade, slot[::2])
    model = quality.fit(row, slot, np.zeros((n, quality.DENSE)), grade, np.ones(n))

    def loss(weights, cuts):
        total = 0.5 * quality.L2 * (weights**2).sum()
        for i in range(n):
            z = sum(weights[s] for s in slot[2 * i : 2 * i + 2])
            tails = [1.0, *(1 / (1 + math.exp(c - z)) for c in cuts), 0.0]
            total -= math.log(tails[grade[i]] - tails[grade[i] + 1]) / n
        return total

    weights, cuts = model.weights[:6], model.thresholds
    best = loss(weights, cuts)
    for j in range(6):
        for step in (-0.2, 0.2):
            assert loss(weights + step * (np.arange(6) == j), cuts) > best - 1e-4
    for step in ([0.2, 0.2], [-0.2, 0], [0, 0.2]):
        assert loss(weights, cuts + np.array(step)) > best - 1e-4
    z = np.array([0.3, -1.0])
    assert np.allclose(model.tails(z), 1 / (1 + np.exp(cuts[None, :] - z[:, None])))


def test_markov_ratio_against_counts():
    """Witten-Bell probabilities by dictionaries, and the verdict by the two models' difference."""
    kinds = [[b"shop-a", b"shop-b", b"shop"], [b"news", b"new-a"]]

    def p(texts, order, before, byte):
        if order < 0:
            return 1 / 256
        context = (b"\x02" * 7 + before)[len(before) + 7 - order :] if order else b""
        follow = [(b"\x02" * 7 + t)[i + 7] for t in texts for i in range(len(t)) if (b"\x02" * 7 + t)[i + 7 - order : i + 7] == context]
        lower = p(texts, order - 1, before, byte)
        return (follow.count(byte) + len(set(follow)) * lower) / (len(follow) + len(set(follow))) if follow else lower

    for texts in kinds:
        model = urlfilter.MarkovModel(texts, 3)
        for url in (b"shop-news", b"new", b"zz"):
            assert model.log_likelihoods([url])[0] == pytest.approx(sum(math.log(p(texts, 3, url[:i], url[i])) for i in range(len(url))))
    ratio = urlfilter.UrlRatio(*kinds, order=3)
    allow, block = (m.log_likelihoods([b"shop-x"])[0] for m in ratio.models)
    assert ratio.score([b"shop-x"])[0] == pytest.approx((allow - block) / 6 - ratio.threshold)


def test_only_low_grades_still_keep_the_better_ones(spark):
    docs = [(i, ("good words here " if i % 2 else "bad noise there ") * 5) for i in range(60)]
    model = quality.trained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int"))
    rows = quality.rated(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert {r["doc_id"] for r in rows if r["keep"]} == set(range(1, 60, 2))


def test_shuffled_counts_keep_single_precision_and_the_likelihood_more(spark):
    rng = np.random.default_rng(17)
    seen = rng.gamma(0.02, size=(500, 8)) * 1e6
    sent = hmm.shipped(seen)
    total = seen.sum(axis=1, keepdims=True)
    small = seen < hmm.EPSILON * total
    assert small.mean() > 0.3 and (sent[small] == 0).all() and (sent[~small] > 0).all()
    assert (abs(sent - seen) <= hmm.EPSILON * total).all()
    texts = [np.append(rng.integers(0, 40, 60), 40).astype(np.uint16) for _ in range(30)]
    model = hmm.random_start(np.full(41, 1 / 41), states=3)
    rows = spark.createDataFrame([(t.tobytes(), False) for t in texts], "syms binary, held_out boolean").repartition(5)
    first, pairs, emitted, likelihood = hmm._counts_over(rows, model, 41)
    expected = hmm.expected(model, *hmm.windows(texts, 41), 41)
    for got, wanted in zip((first, pairs, emitted), expected):
        assert np.allclose(got, wanted, rtol=1e-5, atol=1e-5)
    assert abs(likelihood - expected[3]) < 1e-5 * abs(likelihood) and likelihood != float(np.float32(likelihood))
