"""Operators on tables against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from quiverseq.llm import jaccard, linededup, media, mixing, registry, sharding, spotsigs
from quiverseq.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def jump(key, n):
    bucket, following = -1, 0
    while following < n:
        bucket = following
        key = (key * sharding.MULTIPLIER + 1) & (1 << 64) - 1
        following = int((bucket + 1) * (2.0**31 / ((key >> 33) + 1)))
    return bucket


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 255, (1 << 60) - 1, *random.Random(1).sample(range(1 << 60), 200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 16, 17):
        got = [r[0] for r in rows.select(sharding.jump_hash(rows["k"], n)).collect()]
        assert got == [jump(k, n) for k in keys]


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    rows = registry.QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 0.5 * len(rows) / 17 < moved < 1.5 * len(rows) / 17
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in rows)


def filled(sizes, weights, share=1.5, ceiling=2.0):
    target, total, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > ceiling * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: ceiling * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_water_filled(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 900, rng.randint(1, 2000)]) for i in range(rng.randint(1, 9))}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    names = sorted(sizes)
    expected = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    for r in mixing.source_targets(rows).collect():
        assert r["target"] == pytest.approx(expected[r["source"]], rel=1e-9)


def test_mix_takes_what_it_should(spark):
    rows = registry.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by.setdefault(sources[r["doc_id"]], []).append(r)
    for own in by.values():
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * largest
    again = registry.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def grams(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(docs, k, num, den):
    sets = {i: grams(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, num, growth", [(3, 90, 2), (5, 80, 8), (3, 50, 2)])
def test_jaccard_components_against_brute_force(spark, monkeypatch, k, num, growth):
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    rng = random.Random(k * num)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 60))] for _ in range(12)]
    docs = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words) if i % 20 else rng.choice(["", "one two", None, "x"])))
    rows = jaccard.near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, k, num, 100)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 6)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    common = [f"boilerplate {i}" for i in range(12)]
    docs = []
    for i in range(120):
        lines = [rng.choice([*common[: 1 + i % 12], f"own {i} {j}", "", " "]) for j in range(rng.randint(0, 6))]
        docs.append((i, "\n".join(lines), rng.choice([*[f"s{j}" for j in range(9)], None])))
    sites = {}
    for i, text, source in docs:
        for line in set(text.split("\n")):
            if WORD.search(line):
                sites.setdefault(line, []).append((source, i))
    bad = {line: min(i for _, i in v) for line, v in sites.items() if len({s for s, _ in v}) >= 5}
    assert bad and len(bad) < 12
    rows = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), min_sites=5).collect()
    for r in rows:
        lines = docs[r["doc_id"]][1].split("\n")
        kept = [x for x in lines if bad.get(x, r["doc_id"]) >= r["doc_id"]]
        assert (r["text"], r["n_lines"], r["n_removed"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_fingerprints_follow_the_contract(spark):
    rows = {r["doc_id"]: r for r in spotsigs.op6_fingerprints(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    seen = {}
    for i, following in zip(order, [*order[1:], order[0]]):
        n = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - n] + texts[following][:n]
        assert rows[i]["n_chars"] == len(texts[i]) and rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert seen.setdefault(texts[i], rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        a, b = rows[i]["fingerprint"], rows[following]["fingerprint"]
        assert (rows[i]["near_next"] == 1.0) == (a == b)
    assert sum(r["near_edited"] for r in rows.values()) > 10 * sum(r["near_next"] for r in rows.values())


def test_media_survive_storing(spark):
    rows = {r["doc_id"]: r for r in media.op7_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        data = (d["text"] or "").encode()
        payload = media.padded(data)
        image = media.to_png(payload)
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(payload))
        assert (r["position"], r["caption"]) == (1, f"Text of document {d['doc_id']}")
        assert media.from_png(image) == payload


def test_html_keeps_order_captions_and_unknown_references(spark):
    html = "<h1>T</h1>a <b>b</b><p>c<figure><img src='digest:k1'><figcaption>one &amp; 1</figcaption></figure>d<script>no</script><img data-digest=k2 alt=two><img src='x.png'>"
    pieces = media.parse(html)
    assert [(p["position"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in pieces] == [
        (0, "text", "T", None), (1, "text", "a b", None), (2, "text", "c", None), (3, "media", "k1", "one & 1"), (4, "text", "d", None), (5, "media", "k2", "two"), (6, "media", "x.png", None),
    ]
    pages = media.sequences(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    features = media.described(media.store(spark.createDataFrame([("k1", b"abc"), ("k1", b"abc")], "digest string, data binary")))
    found = {r["position"]: r for r in media.resolved(pages, features, "page_id").collect()}
    assert {p: r["n_bytes"] for p, r in found.items()} == {3: 3, 5: None, 6: None}


def test_damaged_media_are_noticed():
    image = bytearray(media.to_png(media.padded(b"text")))
    image[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


@pytest.mark.parametrize("num", [60, 80])
def test_spotsigs_near_duplicates_against_brute_force(spark, num):
    from test_llm_text import brute_signatures

    rng = random.Random(num)
    content = [f"w{i}" for i in range(60)]
    base = [[w for _ in range(rng.randint(5, 25)) for w in (rng.choice("ab"), *rng.sample(content, rng.randint(1, 3)))] for _ in range(8)]
    docs = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(content)
        docs.append((i, " ".join(words) if i % 15 else rng.choice(["", None, "w1 w2"])))
    from quiverseq.llm.textkernels import Words, text_bytes

    anchors = Words(*text_bytes(__import__("pyarrow").array(["a b"]))).hash.view("int64").tolist()
    sets = {i: brute_signatures(t or "", {"a", "b"}) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), anchors, num=num).collect()
    assert {r["doc_id"]: (r["n_signatures"], r["component_id"]) for r in rows} == {i: (len(sets[i]), find(i)) for i in sets}


def test_pipeline_keeps_a_long_passage_once(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    said = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [said(51), said(51), said(300), said(50)]  # the last is too short
    docs = []
    for i in range(24):
        lines = [said(120), *[p for j, p in enumerate(passages) if (i + j) % (2 + j) == 0], f"short {i % 3}", ""]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), "hot" if i % 5 else f"s{i}", i + 7000))
    docs += [docs[3], docs[4], (30, docs[0][1] + "\nx", "hot", 1), (31, None, "hot", None), (32, "", "hot", 0), (None, "\n".join([said(120), passages[0]]), "hot", 2), (40, passages[2] + "\n" + passages[1], "hot", 3)]
    given = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int").repartition(3)
    for lines_first in (False, True):
        before = corpus_pipeline.line_dedup_stage(spark, given, "") if lines_first else given
        rows = corpus_pipeline.near_duplicate_stage(spark, before, "").collect()
        whole = {d[0]: d for d in docs if d[0] != 30}
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, whole))
        keeper = {p: min(i for i, d in whole.items() if i is not None and p in (d[1] or "").split("\n")) for p in passages[:3]}
        for r in rows:
            _, text, source, n = whole[r["doc_id"]]
            kept = None if text is None else "\n".join(x for x in text.split("\n") if keeper.get(x, r["doc_id"]) == r["doc_id"])
            assert (r["text"], r["source"]) == (kept, source)
            if not lines_first:
                assert r["n_chars"] == (n if kept == text else len(kept))


def test_sequences_are_put_together_again(spark):
    html = "<p>a</p><figure><img src='digest:k1'><figcaption>one</figcaption></figure><p>b</p><img src='digest:k2'><p>c</p>"
    pages = media.sequences(spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None), (None, "<img src='digest:k1'>")], "page_id int, html string"))
    features = media.described(media.store(spark.createDataFrame([("k1", b"abc")], "digest string, data binary")))
    found = {r["page_id"]: r["sequence"] for r in media.interleaved(pages, features, "page_id").collect()}
    assert [(p["position"], p["kind"], p["text"] or p["digest"], p["caption"], p["payload"] and p["payload"]["n_bytes"]) for p in found[1]] == [
        (0, "text", "a", None, None), (1, "media", "k1", "one", 3), (2, "text", "b", None, None), (3, "media", "k2", None, None), (4, "text", "c", None, None),
    ]
    assert [p["text"] for p in found[2]] == ["x"] and found[3] == [] and len(found) == 4


def test_pages_keep_their_text_and_resolve_their_figure(spark):
    rows = {r["page_id"]: r for r in media.page_sequences(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert len(rows) == len(pages)
    for page in pages:
        texts = [p["text"] for p in media.parse(page["html"]) if p["kind"] == "text"]
        r = rows[page["page_id"]]
        assert (r["n_media"], r["n_resolved"]) == (1, int(page["page_id"] in docs))
        assert r["text_sha256"] == hashlib.sha256("\n".join(texts).encode()).hexdigest() and r["n_pieces"] == len(texts) + 1


def test_shards_of_the_query_are_the_published_ones(spark):
    rows = registry.QUERIES["op5_sharding"](spark, SF).collect()
    for r in rows:
        key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))


def test_fingerprints_are_alike_by_their_jaccard(spark):
    import base64

    sigs = lambda s: {base64.b64decode(s)[i : i + 4] for i in range(0, len(base64.b64decode(s)), 4)}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    rows = {r["doc_id"]: r for r in spotsigs.op6_fingerprints(spark, SF).collect()}
    order = sorted(rows, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]]):
        own = sigs(rows[i]["fingerprint"])
        assert rows[i]["near_edited"] == pytest.approx(alike(own, sigs(rows[i]["edited_fingerprint"])))
        assert rows[i]["near_next"] == pytest.approx(alike(own, sigs(rows[following]["fingerprint"])))
