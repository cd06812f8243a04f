import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import ann, bpe, exact_dedup, html_text, ngram_join, packing, quality, suffix_dedup, url_filter, warc
from roadweave.llm.components import components

WORDS = "alpha beta gamma delta omega river stone cloud light paper green seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base, passage = prose(rng, 60), prose(rng, 50)
    out = [base, base, base.upper(), base.replace("1", "2", 1), base + " tail", None, "", "", " \n\t ", "one", "one two", "É́ é 日本語 " * 20]
    out += [prose(rng, 30) + passage + prose(rng, 20) for _ in range(4)] + ["ab " * 300, "x" * 700, prose(rng, 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "s") for i, t in enumerate(texts)] + [(None, "loose", "c", "s"), (0, texts[0], "again", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, sha string, score string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("bits,block", [(64, 4096), (3, 16), (64, 7)])
def test_exact_groups(docs, bits, block):
    rows = docs.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    got = exact_dedup.exact_groups(docs, block_bytes=block, hash_bits=bits).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        ids = groups[lower(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want[(r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(lower(r.text).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_keep_one_keeps_columns(docs):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == len({lower(r.text) for r in docs.collect()})


@pytest.mark.parametrize("m,bucket", [(200, 1 << 18), (200, 500), (20, 2000)])
def test_suffix_dedup(docs, m, bucket):
    rows = docs.select("doc_id", "text").collect()
    data = [(r.text or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + m] for t in data for i in range(len(t) - m + 1))
    want = collections.Counter()
    for r, t in zip(rows, data, strict=True):
        cover = bytearray(len(t))
        for i in range(len(t) - m + 1):
            if seen[t[i : i + m]] > 1:
                cover[i : i + m] = b"\1" * m
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        want[(r.doc_id, len(t), sum(cover), runs, bytes(b for b, c in zip(t, cover, strict=True) if not c))] += 1
    got = suffix_dedup.repeated_spans(docs, min_bytes=m, bucket_bytes=bucket).collect()
    assert collections.Counter((*r[:4], bytes(r.kept)) for r in got) == want
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def test_parts_of_a_crowded_anchor_keep_equal_windows_together():
    rng, m = random.Random(2), 60
    shared = bytes(rng.choice(b"abcdef ") for _ in range(90))
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) + shared + bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(60)] + [b"xyz" * 70]
    for parts in (2, 4, 8, 64):
        names: dict[bytes, set] = collections.defaultdict(set)
        seen = 0
        for t in data:
            for h, _, start, n, _ in zip(*suffix_dedup.segments_of(t, m), strict=True):
                piece = t[start : start + n + m - 1]
                found = suffix_dedup.parts_of(piece, int(h.view(np.int64)), parts, m)
                assert [x for _, a, k in found for x in range(a, a + k)] == list(range(n))
                for name, a, k in found:
                    for i in range(a, a + k):
                        names[piece[i : i + m]].add(name)
                        seen += 1
        assert all(len(x) == 1 for x in names.values()) and len(names) < seen
        if parts == 64:  # one place each: a name is a window
            assert len({min(x) for x in names.values()}) == len(names)


def test_suffix_dedup_of_a_passage_in_most_documents(spark):
    """Segments of one anchor outgrow a bucket many times; each is decided like brute force."""
    rng, m = random.Random(12), 50
    passage = prose(rng, 12)
    texts = [prose(rng, 6) + passage + prose(rng, 6) for _ in range(120)] + [prose(rng, 20), "short"]
    data = [t.encode() for t in texts]
    seen = collections.Counter(t[i : i + m] for t in data for i in range(len(t) - m + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeated_spans(df, min_bytes=m, bucket_bytes=1500).collect()}
    for d, t in enumerate(data):
        cover = bytearray(len(t))
        for i in range(len(t) - m + 1):
            if seen[t[i : i + m]] > 1:
                cover[i : i + m] = b"\1" * m
        assert got[d] == (sum(cover), sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1])))


def test_interval_expansion_random():
    rng = random.Random(5)
    for _ in range(60):
        m = rng.choice([1, 2, 5, 9])
        data = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        seen = collections.Counter(t[i : i + m] for t in data for i in range(len(t) - m + 1))
        want = [[i for i in range(len(t) - m + 1) if seen[t[i : i + m]] > 1] for t in data]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(data, m)] == want


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute_groups(pool, words, percent):
    """(set size, least linked place) of each text, by all pairs."""
    sets = [shingles(t, words) for t in pool]
    names = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    parent = list(range(len(pool)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    matrix = np.zeros((len(pool), len(names)), dtype=np.float32)
    for row, x in zip(matrix, sets, strict=True):
        row[[names[i] for i in x]] = 1
    shared, sizes = matrix @ matrix.T, matrix.sum(1)
    linked = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0)
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        parent[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in enumerate(sets)}


def joined_groups(spark, pool, words, percent):
    df = spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df, words=words, percent=percent).collect()}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, words, percent):
    rng = random.Random(words)
    pool = []
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 60))]
        for _ in range(6):
            copy = [w if rng.random() > 0.03 else "edit" + str(rng.randrange(99)) for w in base]
            pool.append(" ".join(copy))
    pool += ["", None, " ", "one", "ONE", "one two"]
    assert joined_groups(spark, pool, words, percent) == brute_groups(pool, words, percent)


@pytest.mark.parametrize("rate", [0.004, 0.02])
def test_ngram_join_of_regions_larger_than_a_task(spark, monkeypatch, rate):
    """Families that share a passage, and a pivot that few of them are linked with; blocks are a few rows, so every round runs."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    monkeypatch.setattr(ngram_join, "SCREEN_ROWS", 40)
    rng = random.Random(8)
    shared = [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(60)]
    pool = [" ".join(shared + [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(4)])]
    for _ in range(3):
        base = shared + [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(12)]
        for _ in range(100):
            pool.append(" ".join(w if rng.random() > rate else f"edit{rng.randrange(10**6)}" for w in base))
    assert joined_groups(spark, pool, 3, 90) == brute_groups(pool, 3, 90)


def test_ngram_join_of_one_large_group(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(150)]
    pool = [" ".join(base[:140])]
    for i in range(3000):
        copy = list(base)
        copy[20 + i % 100] = f"own{i}"
        pool.append(" ".join(copy))
    assert joined_groups(spark, pool, 3, 90) == brute_groups(pool, 3, 90)


def test_ngram_join_of_names_that_clash(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_digest", lambda items: (len(items) // 8 % 3, int(np.bitwise_xor.reduce(np.frombuffer(items, dtype=np.int64))) if items else 0))
    rng = random.Random(4)
    pool = [prose(rng, 40) for _ in range(20)]
    pool += [t + " tail" for t in pool[:5]] + pool[:3]
    assert joined_groups(spark, pool, 3, 80) == brute_groups(pool, 3, 80)


def test_ngram_join_edge_tables(docs):
    assert ngram_join.similar_groups(docs).count() == docs.count()
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


def test_join_region_matches_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = []
    for _ in range(300):
        s = base.copy()
        s[rng.random(80) < 0.06] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    got = ngram_join.join_region(sets, np.arange(len(sets)), 90)
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                want.add((i, j))
    assert {(min(p), max(p)) for p in got} <= want

    def groups(links):
        label = list(range(len(sets)))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    assert groups(got) == groups(want)
    assert len(got) == len(sets) - len(groups(want))  # a forest


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 50 == 0, 5, list_rows=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    hit = 0
    for q in range(0, 600, 50):
        s = (y @ y[q]) / (np.sqrt((y * y).sum(1)) * np.sqrt((y[q] * y[q]).sum()))
        s[q] = -9
        want = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hit += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 5
    assert hit >= 0.9 * 60
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert 900 not in got
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0
    few = ann.nearest(df.filter("vec_id < 3"), F.col("id") == 0, 5).collect()
    assert [r.rank for r in few] == [1, 2]


def test_nearest_recall_with_many_more_lists_than_probes(spark):
    n, every = 6000, 30
    x = np.random.default_rng(4).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert n // 20 > 10 * ann.PROBES
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("id") % every == 0, 5, list_rows=20).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, n, every):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.94 * 5 * (n // every)


def test_nearest_with_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 0.995037), (2, 2, 0.707107), (3, 1, 0.0)]
    assert ann.nearest(df.limit(0), F.col("id") == 0, 5).count() == 0


def test_quality_risk_against_plain_loops():
    """The fitted weights lower the non-negative risk computed row by row, and more steps don't raise it much."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.7, 1, (80, 6)).astype(np.float32), np.concatenate([rng.normal(0.7, 1, (60, 6)), rng.normal(-0.7, 1, (90, 6))]).astype(np.float32)

    def risk(model):
        def loss(x, y):
            return float(np.log1p(np.exp(-y * (sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True)) + model.bias))))

        plus = sum(loss(x, 1) for x in p) / len(p)
        minus = sum(loss(x, -1) for x in u) / len(u) - 0.4 * sum(loss(x, -1) for x in p) / len(p)
        return 0.4 * plus + max(0.0, minus)

    first, half, full = (quality.fit(p, u, 0.4, steps=n) for n in (0, 100, 400))
    assert risk(full) <= risk(half) + 0.01 < risk(first)
    best = risk(full)
    for i in range(6):  # no single weight does much better elsewhere
        for step in (-0.3, 0.3):
            w = full.weights.copy()
            w[i] += step
            assert risk(quality.Model(w, full.bias, full.mean, full.scale, 0.4)) > best - 0.01


def test_quality_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w + ("!!" if i % 5 == 0 else "") for w in prose(rng, 40).split())) for i in range(400)] + [(9999, None), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(out) == 402 and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.3) == (i % 5 != 0) for i in held) >= 0.95 * len(held)
    assert quality.train(docs, labels.limit(0)) == 0.5
    assert quality.score(docs.limit(0), model).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 9000 + "WARC/1.1\r\n" + "0\r\n\r\nWARC/1.1"
    rows = [(1, "u1", "a" * 1500), (2, "u2", "a" * 1500), (3, "u\r\n3", "a" * 1500), (4, None, big), (5, "u5", None), (6, "u6", "short"), (7, "u7", "short"), (None, "u8", "null key")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_warc(pages, str(tmp_path / "w"), segment_chars=3000)
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        r, data = got[str(i) if i else ""], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", "3") if i in (1, 2) else ("response", None))
        if r.record_type == "response":
            assert bytes(r.payload) == data
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.filter("kind = 'continuation'").count() > 3


def test_warc_without_its_last_segment(spark, tmp_path):
    """A record whose last continuation is lost is refused, chunked or not."""
    head = "WARC-Type: {kind}\r\nWARC-Record-ID: <{id}>\r\n{more}WARC-Page-ID: 1\r\nContent-Length: {n}\r\n\r\n{block}\r\n\r\n"
    first = "HTTP/1.1 200 OK\r\n\r\nhalf"
    text = warc.VERSION_LINE + head.format(kind="response", id="a", more="WARC-Segment-Number: 1\r\n", n=len(first), block=first)
    last = warc.VERSION_LINE + head.format(kind="continuation", id="b", more=f"WARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: {len(first) + 4}\r\n", n=4, block="over")
    (tmp_path / "whole.warc").write_text(text + last, newline="")
    (tmp_path / "lost.warc").write_text(text, newline="")
    assert [bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path / "whole.warc")).collect()] == [b"halfover"]
    with pytest.raises(Exception, match="lacks its last segment"):
        warc.read_warc(spark, str(tmp_path / "lost.warc")).collect()


def test_chunk_framing():
    for text in ("", "a", "é" * 5000, "WARC/1.1WARC/1.1\r\n"):
        framed = warc.chunked(text, 100)
        assert "WARC/1.1" not in framed
        assert warc.dechunked(framed.encode()) == text.encode()


def test_packing(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = bpe.tokenizer_from_file(path)
    pieces = packing.pack(docs, path).collect()
    whole = collections.defaultdict(list)
    for r in docs.collect():
        whole[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    by_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        bins[p.sequence_id].append((p.offset, p.length))
    for d, lists in whole.items():
        assert sum(len(x) for x in lists) == sum(len(i) for _, i, _ in by_doc[d])
        if len(lists) == 1:
            assert [t for _, i, _ in sorted(by_doc[d]) for t in i] == lists[0]
            assert {n for _, _, n in by_doc[d]} == {len(lists[0])}
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(docs.limit(0), path).count() == 0
    assert all(sum(packing.piece_lengths(n, 2048)) == n for n in range(1, 5000))


def test_packing_of_long_texts_over_batches(spark):
    """Texts of many sequences, batches of two rows: no id is lost, and little is padded."""
    import public_tokenizers

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    texts = [prose(rng, n) for n in [6000, 3, 900, 1, 2500, *(rng.randrange(1, 500) for _ in range(120))]]
    tokenizer = bpe.tokenizer_from_file(path)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    by_doc, bins = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        bins[p.sequence_id] += p.length
    for i, t in enumerate(texts):
        assert [x for _, ids in sorted(by_doc[i]) for x in ids] == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    total = sum(bins.values())
    assert max(bins.values()) <= 2048 and total / (2048 * len(bins)) > 0.95


def test_url_filter(spark):
    urls = ["http://A.example.org/es/x", "http://example.org/en/12?q", "http://b.org", "http://b.org/", "https://x.com/de/1#f", "https://x.com/fr/casino", "http://n.net/casino", "http://n.net/casinos", "http://n.net/free-spam", "http://n.net/free/free", "nothing", None, "HTTP://Spam-Farm.net?x", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "", None, "allow")
    assert got[3] == ("b.org", "/", "org/", "allow")
    assert got[4] == ("x.com", "/de/1", "com/de/", "block")
    assert got[5][2:] == ("com/fr/", "allow")
    assert [got[i][3] for i in (6, 7, 8, 9)] == ["block", "allow", "block", "allow"]
    assert got[10] == got[11] == ("", "", None, "allow")
    assert got[12][:2] == ("spam-farm.net", "") and got[12][3] == "block"
    assert got[13][:2] == ("b:", "//c/d")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_vocabulary_of_a_file(spark, tmp_path):
    terms = [f"strict bad{i}" for i in range(3000)] + [f"soft meh{i}" for i in range(3000)]
    (tmp_path / "terms.txt").write_text("# terms\n\n" + "\n".join(terms) + "\nstrict bad1\n")
    strict, soft = url_filter.read_vocabulary(spark, str(tmp_path / "terms.txt"))
    assert len(strict) == len(soft) == 3000
    urls = ["http://a.net/bad2999/", "http://a.net/xbad7", "http://a.net/?q=meh5-meh5", "http://a.net/meh5#meh2998"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, strict=strict, soft=soft, rules=()).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block"}
    (tmp_path / "odd.txt").write_text("hard x\n")
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(spark, str(tmp_path / "odd.txt"))


def test_url_filter_reads_query_fragment_and_bare_urls(spark):
    urls = ["https://x.net/search?q=porn", "https://x.net/#free+loan", "https://x.net/free?x=LOAN", "x.net/casino", "https://x.com/fr/?q=porn", "https://x.net/?q=popcorn", "https://x.net/?q=free"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.strict_hits, r.soft_hits, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        0: ("x.net", "/search", 1, 0, "block"),
        1: ("x.net", "/", 0, 2, "block"),
        2: ("x.net", "/free", 0, 2, "block"),
        3: ("", "", 1, 0, "block"),
        4: ("x.com", "/fr/", 1, 0, "allow"),
        5: ("x.net", "/", 0, 0, "allow"),
        6: ("x.net", "/", 0, 1, "allow"),
    }


def test_html_rendering():
    page = "<title>t</title><ul><li>One<li>Two<ul><li>in</ul></ul><h1>H</h1><p>a <b>b</b>c<br>d<p>e &amp;<table><tr><th>A<th>Long<tr><td>1<td>2</table><pre> x\n  y</pre><div>f</div><div>g<i style='display:none'>no</i></div><script>z</script>"
    assert html_text.render(page) == "- One\n- Two\n  - in\n\nH\n\na bc\nd\n\ne &\n\nA | Long\n1 | 2\n\n x\n  y\n\nf\ng"
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("plain  text") == "plain text"
    assert html_text.render("<ol start=3><li>a<li>b</ol>") == "3. a\n4. b"
    assert html_text.render("<div>" * 5000 + "deep") == "deep"
    assert html_text.render("</p></td><td>loose<li>item") != ""


def test_html_head_without_end():
    for page in (
        "<html><head><title>T</title><p>Hello<p>you",
        "<head><title>T</title><link rel=x><script>z</script>\n<base href=/><style>s</style><p>Hello</p><p>you</p></html>",
        "<title>T</title><meta charset=x><head><title>T</title><p>Hello<p>you",
        "<head><head><title>T</title></head><p>Hello<p>you",
        "<head><title>T</title>Hello<p>you",
        "<head><noscript><p>no</noscript><template><p>no</template><body><p>Hello<p>you",
    ):
        assert html_text.render(page).split() == ["Hello", "you"], page


def test_html_math_svg_and_forms():
    show = html_text.render
    assert show("<p>if <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>tex</annotation></semantics></math> then") == "if x=2 then"
    chart = "<p>Up<svg><title>t</title><desc/><defs><text>no</text></defs>loose<g><rect/><text x=1>Jan</text><text>Feb <tspan>b</tspan></text></g></svg>on"
    assert show(chart) == "Up\nJan\nFeb b\non"
    assert show("<svg><foreignObject><p>in</p></foreignObject><path d=x></svg><p>out") == "in\n\nout"
    assert show("<svg><g><p>out<math><mtext/>a</math>") == "outa"
    assert show("a <textarea>\nx  &amp; y\n z</textarea> b") == "a\nx  & y\n z\nb"
    assert show("<textarea><b>x</b> &lt;</textarea><b>y</b> &lt;") == "<b>x</b> <\ny <"
    assert show("<p>a<textarea>open &amp; b") == "a\nopen & b"
    assert show("Size <select><option>S<option selected>M<option>L</select> now") == "Size M now"
    assert show("<select><option disabled>pick<optgroup label=g><option>S<option>M</select>") == "S"
    assert show("<select multiple><optgroup label=g><option>S<option label=Mid>M</select>x") == "g\nS\nMid\nx"
    assert show("<input value=no><datalist><option>no</datalist>yes") == "yes"


def test_html_broken_markup():
    show = html_text.render
    assert show("a<td colspan='²'>x") == "ax"
    assert show("<table><tr><td colspan='²'>x<td colspan=99999999999999>y</table>") == "x | y"
    assert show("<ol start='²'><li>a") == show("<ol start='" + "9" * 5000 + "'><li>a") == "1. a"
    assert show("<ol start=' -2'><li>a<li>b") == "-2. a\n-1. b"
    assert show("a<![foo[ x") == show("a<!-- x") == show("a<?php x") == show("a<!doctype") == "a"
    assert show("<!-->a<!--->b<!-- c --!>d<!-- - -- > -->e<?php x ?>f") == "abdef"
    assert show("<svg><text><![CDATA[a<b>]]></text></svg>") == "a<b>"
    assert show("&#" + "9" * 6000 + ";x &#0000000000065;") == "\ufffdx A"
    assert show("<p style='a' style='display:none'>a") == "a"


def test_html_cells_of_several_lines():
    show = html_text.render
    assert show("<table><tr><td><table><tr><td>a<td>bb<tr><td>c<td>d</table><td>z</table>") == "a | bb | z\nc | d  |"
    assert show("<table><tr><td><pre>a\n  b</pre><td>c<tr><td>long cell<td>e</table>") == "a         | c\n  b       |\nlong cell | e"


def test_html_cells_on_a_grid():
    show = html_text.render
    assert show("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A | b\n  | c\nd | e"
    assert show("<table><tr><th colspan=2>wide head<th>x<tr><td>1<td>2<td>3</table>") == "wide head | x\n1 | 2     | 3"
    assert show("<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "A | b\n  | c\nd | e"
    assert show("<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "日本 | x\nabcd | y\ne\u0301    | z"
    long = "w " * 50
    assert show(f"<table><tr><td>a<td>{long}<td>b<td>c<tr><td>1<td>2<td>3<td>4</table>") == f"a\n{long.strip()}\nb | c\n1 | 2 | 3 | 4"


def test_html_layout_brute_force():
    """Tables of spanned cells against a grid of single fields and column widths raised until every cell fits."""
    rng = random.Random(11)
    for _ in range(400):
        table = [[(rng.choice(["", "a", "bb", "cccc", "d" * 9]), rng.randrange(1, 4), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in table) + "</table>"
        taken, cells = set(), []
        for r, row in enumerate(table):
            c = 0
            for text, across, down in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
                cells.append((r, c, c + across, text))
                c += across
        firsts = sorted({c for _, c, _, _ in cells})
        begin = dict.fromkeys(range(max(e for _, _, e, _ in cells) + 1), 0)
        moved = True
        while moved:
            moved = False
            for _, c, e, text in cells:
                for f in (f for f in firsts if f >= e):
                    if begin[f] < begin[c] + len(text) + 3:
                        begin[f], moved = begin[c] + len(text) + 3, True
        want = []
        for r in range(len(table)):
            line = ""
            for _, c, _, text in (x for x in cells if x[0] == r):
                line = line.ljust(begin[c] - 3) + (" | " if begin[c] else "") + text
            want.append(line.rstrip())
        assert html_text.render(page).split("\n") == "\n".join(x for x in want).strip("\n").split("\n"), page


def test_html_of_hostile_pages():
    """Text and time stay in proportion to the page, and no word is lost."""
    pages = {
        "one wide cell": "<table><tr><td>" + "x" * 100_000 + "<tr><td>a<td>b" * 10_000 + "</table>",
        "wide first column": "<table><tr><td>" + "x " * 50_000 + "<td>z" + "<tr><td>a<td>b" * 10_000 + "</table>",
        "colspan": "<table>" + "<tr><td colspan=1000>x<td>y" * 4_000 + "</table>",
        "nested colspan": "<table><tr><td colspan=1000>x" * 1_000,
        "nested": "<table><tr><td>a<br>b<br>c<td>" * 3_000 + "y" * 50_000,
        "many columns": "<table><tr>" + ("<td>" + "h" * 60) * 2_000 + "<tr><td colspan=1000>x<td>y" * 5_000 + "</table>",
        "rowspan": "<table><tr>" + "<td rowspan=9999>x" * 5_000 + "<tr><td>x" * 5_000 + "</table>",
        "tall cell": "<table><tr><td><pre>" + "a\n" * 20_000 + "</pre>" + "<td>b" * 5_000,
        "divs": "<div>" * 100_000 + "x",
        "divs in a paragraph": "<p><button>" + "<div>" * 100_000 + "x",
        "svg": "<svg><text>" + "<g>x" * 50_000,
        "lists": "<ul><li>x" * 10_000,
        "indented lines": "<ul><li>" * 40 + "<pre>" + "x\n" * 50_000,
    }
    for name, page in pages.items():
        began = time.process_time()
        text = html_text.render(page)
        assert time.process_time() - began < 20, name  # before the bounds: minutes, or gigabytes
        assert len(text) <= 100 * len(page), name
        assert len(re.sub(r"[\s|-]", "", text)) == len(re.sub(r"<[^>]*>|\s", "", page)), name


def test_html_query(spark, tmp_path):
    """The registered query against plain calls."""
    rows = [(1, "<p>a<p>b"), (2, None), (3, ""), (4, "<table><tr><td>x<td>y</table>"), (4, "<table><tr><td>x<td>y</table>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, html_text.op9_html_extraction(spark, str(tmp_path)).collect()))
    assert got == sorted((i, html_text.render(h), len(html_text.render(h))) for i, h in rows)


def test_html_of_mutated_pages():
    """No markup raises, and no page shows what is not in it."""
    rng = random.Random(0)
    bits = ["<", ">", "<!--", "-->", "<![", "]]>", "<?", "&#", "&#x", "'", '"', "=", "</", "/>", "<table>", "</table>", "<td colspan=", "<ol start=", "<select size=", "<svg>", "<math>", "<pre>", "<textarea>", "</textarea>", "<script>", "</script>", "<li>", "\0", "<title>", "²", "9" * 5000]
    tags = "div p span b ul ol li table tr td th h1 pre svg math text select option textarea details summary a".split()
    for _ in range(10_000):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "w ", rng.choice(bits)]) for _ in range(rng.randrange(30)))
        assert isinstance(html_text.render(page), str), page


def test_html_shows_all_visible_words_in_order():
    """Random trees against a plain walk: every word outside hidden elements, once and in order."""
    rng, serial = random.Random(5), iter(range(10**9))

    def tree(depth):
        words, html = [], []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice("text block inline list hidden table".split()) if depth else "text"
            if kind == "text":
                word = f"w{next(serial)}"
                words.append(word)
                html.append(f" {word} ")
            elif kind == "table":
                rows = [[tree(0) for _ in range(2)] for _ in range(2)]
                words += [w for r in rows for inner, _ in r for w in inner]
                html.append("<table>" + "".join("<tr>" + "".join(f"<td>{h}" for _, h in r) for r in rows) + "</table>")
            else:
                inner, made = tree(depth - 1)
                opened, closed = {"block": ("<div>", "</div>"), "inline": ("<em>", "</em>"), "list": ("<ul><li>", "</ul>"), "hidden": ("<div hidden>", "</div>")}[kind]
                words += [] if kind == "hidden" else inner
                html.append(opened + made + closed)
        return words, "".join(html)

    for _ in range(300):
        words, page = tree(4)
        assert [w for w in html_text.render(page).split() if w.startswith("w")] == words


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>x", "old"), (2, None, "old")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == {1: "x", 2: ""}
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_bpe_equals_tiktoken(spark, docs, texts, monkeypatch):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = bpe.encode_decode(docs, path, pattern).collect()
    source = docs.collect()
    want = collections.Counter((r.doc_id, tuple(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in source)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows) == want
    encoder, rng = bpe.Encoder(bpe.tokenizer_from_ranks(path, pattern)), random.Random(1)
    odd = list("ab Z9  \n\t'sred!?.é") + [chr(c) for c in (0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x200B, 0x660, 0x1F600, 0x301)]
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(2000)] + ["<|endoftext|>"]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(made)] == [reference.encode_ordinary(t) for t in made]
    rows = [" ".join(rng.choice(["\u00e9t\u00e9", "don't", "x\n", "\ty", "a\u00a0", "\U0001f600"]) + str(rng.randrange(500)) + rng.choice(["", "\n", "\t\t", " "]) for _ in range(30)) for _ in range(200)]
    monkeypatch.setattr(bpe, "CACHE_PARTS", 64)  # both generations turn over many times
    monkeypatch.setattr(bpe, "BATCH_PARTS", 16)
    for at in range(0, 200, 20):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(rows[at : at + 20])] == [reference.encode_ordinary(t) for t in rows[at : at + 20]]
    assert len(encoder.known) <= 64 + 16 and len(encoder.before) <= 64 + 16
    found = bpe.offsets(encoder.tokenizer, "a日b")
    assert [i for i, _, _ in found] == reference.encode_ordinary("a日b")


def test_encoder_work_and_memory_of_rare_words():
    """Words that the cache lacks travel in texts of bounded length, once while they are held, and are held in few bytes."""
    import public_tokenizers

    tokenizer, rng = bpe.tokenizer_from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(9)

    class Spy:
        def __init__(self):
            self.texts = []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return tokenizer.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            self.texts.append(text)
            return tokenizer.encode(text, **options)

        def get_vocab(self, **options):
            return tokenizer.get_vocab(**options)

    words = list({"".join(rng.choice("abcdefgh\u00e9") for _ in range(rng.randrange(5, 15))) for _ in range(20_000)})
    texts = ["", "x", None, " a  b ", *(" ".join(words[i : i + 150]) for i in range(0, len(words), 150))]
    spy = Spy()
    encoder = bpe.Encoder(spy)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == want
    seen = collections.Counter(w for t in spy.texts for w in t.split(" "))
    assert max(len(t.split()) for t in spy.texts) <= 128 and max(seen[w] for w in words) == 1
    spy.texts.clear()
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == want
    assert max(len(t.split()) for t in spy.texts) <= 2  # first words of texts, and what follows two blanks
    assert len(encoder.known) >= 19_000 and (encoder.known.words.nbytes + encoder.known.ids.nbytes) / len(encoder.known) < 64


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [(i, prose(rng, 80), "en", "s", 0) for i in range(120)]
    junk = [(200 + i, "!! ".join(prose(rng, 60).split()), "en", "s", 0) for i in range(40)]
    copies = [(300, good[0][1].capitalize(), "en", "s", 0), (301, good[1][1] + " tail", "en", "s", 0), (302, None, "en", "s", 0)]
    docs = spark.createDataFrame(good + junk + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        seen[name] = {r.doc_id for r in d.collect()}
    assert set(range(120)) <= seen["quality_classifier"] and not seen["quality_classifier"] & set(range(200, 240))
    assert 0 not in seen["exact_dedup"] and 300 in seen["exact_dedup"]
    assert 301 not in seen["near_duplicates"] and 1 in seen["near_duplicates"]
    assert seen["suffix_array_dedup"] == seen["near_duplicates"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == seen["suffix_array_dedup"]
