"""Operators 11 to 13 against plain versions, through their registered queries and with odd input."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from roadweave.llm import clusters, importance, mixing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def some_docs(n=140, seed=5):
    rng = random.Random(seed)
    words = ["Road", "RIVER", "x9", "naïve", "日本", "ſ", "a", "bb", "ccc-d", "İ"]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    out = [(i, text(rng.choice([1, 5, 19, 20, 21, 60, 400])), rng.choice(["a", "b", "B", "é", None])) for i in range(n)]
    return [*out, (n, None, "a"), (n + 1, "", "b"), (n + 2, " .,-", None), (None, text(30), "a"), (None, text(30), "a"), *[out[3]] * 5, (n + 3, None, "wordless")]


def plain_features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in plain_features(x, n)[0]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(sum(s.values()) + buckets) / ((s[b] + 1) * float(sum(t.values()) + buckets))))
    rows = []
    for i, text, _ in docs:
        found, words = plain_features(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    drawn = order[: len(order) * percent // 100]
    return rows, drawn


def test_op11_registered_columns(spark, tmp_path):
    docs, target = some_docs(), ["river9 Road7 x9", None, "日本3 road1 " * 9]
    folder = save(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"), benchmark=([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    got = importance.op11_importance_resampling(spark, folder).collect()
    rows, drawn = plain_resample(docs, target)
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(repr, ((i, n, w, s) for i, _, n, w, s in rows)))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(d[0], d[4]) for d in drawn]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("step", [1, 64, 1 << 20])
def test_features_do_not_cross_documents(n, step):
    texts = [d[1] for d in some_docs(40)] + ["", "one", None, "a b c d " * 50]
    want = [collections.Counter(zlib.crc32(f.encode()) for f in plain_features(t, n)[0]) for t in texts]
    got = [collections.Counter() for _ in texts]
    for document, crc, _ in importance.features([t.encode() if t is not None else None for t in texts], n, step):
        for d, c in zip(document.tolist(), crc.tolist(), strict=True):
            got[d][c] += 1
    assert got == want


def test_resample_two_word_features_clashing_columns_and_empty_tables(spark):
    docs, target = some_docs(), ["road1 river2 road1 river2"] * 3
    schema = "doc_id long, text string, score string"
    d, t = spark.createDataFrame(docs, schema), spark.createDataFrame([(x,) for x in target], "text string")
    rows, drawn = plain_resample(docs, target, n=2, buckets=50, percent=30)
    got = importance.resample(d, t, n=2, buckets=50, percent=30).collect()
    assert sorted((r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(r[1:] for r in rows)
    assert sum(r["rank"] is not None for r in got) == len(drawn)
    assert importance.resample(d.limit(0), t).count() == 0
    assert {r.weight for r in importance.resample(d.filter("text is null"), t.limit(0)).collect()} == {0}


def plain_clusters(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < clusters.LIMIT for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == n]
                if own:
                    centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = collections.Counter()
    for d, n in found if kept else []:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, found if kept else [], strict=True)]


def some_vectors(n=300, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dims)) * 0.1 + rng.integers(0, 4, size=(n, 1)) * 0.2, 2)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(7, v[0].tolist())] * 30 + [(None, v[1].tolist())]
    bad = [None, [], [0.1] * 63, [0.1] * 63 + [None], [0.1] * 63 + [math.nan], [math.inf] * 64, [1e300] * 64]
    return rows + [(1000 + i, b) for i, b in enumerate(bad)]


def test_op12_registered_columns(spark, tmp_path):
    rows = some_vectors()
    folder = save(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>"))
    got = clusters.op12_centroid_clusters(spark, folder)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, plain_clusters(rows)))
    assert dict(got.dtypes)["cluster"] == "int"


def test_clusters_few_equal_and_no_vectors(spark):
    rows = [(i, [float(i % 2), 0.5]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as distance")
    got = clusters.cluster(df, dimensions=2).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_clusters(rows, dims=2))
    assert clusters.cluster(df.limit(0), dimensions=2).count() == 0


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    c = rng.integers(-500, 500, size=(300, 6))
    c[100:120] = c[:20]  # equal centroids: the smaller number wins
    x = np.concatenate([c[rng.integers(0, 300, 400)] + rng.integers(-20, 21, size=(400, 6)), rng.integers(-500, 500, size=(200, 6)), np.zeros((0, 6), dtype=np.int64)])
    which, distance, computed = clusters.SortedCentroids(c).nearest(x)
    every = np.square(x[:, None, :] - c[None]).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 0.7 * every.size


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_mix(docs, seed=13, weights=(5, 2, 1), percent=150, most=2):
    units = collections.Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs)
    size = collections.Counter()
    for (_, s, n), k in units.items():
        size[s] += n * k
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, target, open_, left = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, set(order), percent * sum(size.values()) / 100
    while over := [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > most * size[s]]:
        for s in over:
            target[s] = float(most * size[s])
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    for s in open_:
        target[s] = left * weight[s] / sum(weight[o] for o in open_)
    wanted, words, out = dict(target), dict(size), collections.Counter()
    h = {u: spark_hash(np.int32(seed), u[0], u[2]) for u in units}

    def settle(group, done):
        x = group[0]
        for y in group[1:]:
            full_x, full_y = x[3] * mixing.WORD, y[3] * mixing.WORD
            up, down = min(full_x - x[4], y[4]), min(x[4], full_y - y[4])
            moved = up if spark_hash(x[0], y[0], np.int32(seed)) % max(up + down, 1) < down else -down
            x, y = [*x[:4], x[4] + moved], [*y[:4], y[4] - moved]
            if x[4] in (0, full_x):
                done[x[5 - 4]] = x[4] == full_x
                x = y
            else:
                done[y[1]] = y[4] == full_y
        return x

    for c in sorted({(n.bit_length() - 1) // mixing.CLASS_BITS for _, _, n in units if n}, reverse=True):
        now = [u for u in units if u[2] and (u[2].bit_length() - 1) // mixing.CLASS_BITS == c]
        rate = {s: min(max(wanted[s] / words[s], 0.0), float(most)) for s in {u[1] for u in now}}
        base = {s: math.floor(rate[s]) for s in rate}
        more, open_units = {}, []
        for u in now:
            extra = units[u] * (rate[u[1]] - base[u[1]])
            more[u] = math.floor(extra)
            mass = math.floor((extra - more[u]) * u[2] * mixing.WORD)
            if mass:
                open_units.append([h[u], u, None, u[2], mass])
        bits, done = max(0, math.ceil(math.log2(max(1, len(now)) / mixing.GROUP))), {}
        while open_units:
            groups = collections.defaultdict(list)
            for x in sorted(open_units, key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0, x[3])):
                groups[x[1][1], (x[0] % (1 << 64)) >> (64 - bits)].append(x)
            open_units = [settle(g, done) for g in groups.values()]
            if not bits:
                for x in open_units:
                    done[x[1]] = spark_hash(x[0], np.int32(seed + 1)) % (x[3] * mixing.WORD) < x[4]
                break
            bits = max(0, bits - mixing.GROUP_BITS)
        for u in now:
            copies = more[u] + done.get(u, False)
            for k in range(units[u]):
                out[u[0], u[2], size[u[1]], round(target[u[1]], 6), (base[u[1]] + (k < copies)) * u[2]] += 1
            wanted[u[1]] -= u[2] * (units[u] * base[u[1]] + copies)
            words[u[1]] -= u[2] * units[u]
    for u in units:
        if not u[2]:
            out[u[0], 0, size[u[1]], round(target[u[1]], 6), 0] += units[u]
    return out


def test_op13_registered_columns_near_targets_and_reruns(spark, tmp_path):
    docs = some_docs(900)
    folder = save(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"))
    got = mixing.op13_source_mixing(spark, folder).collect()
    counted = collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got)
    assert counted == plain_mix(docs)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7))
    assert counted == collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in again.collect())
    by = collections.defaultdict(lambda: [0.0, 0, 0])
    for r in again.collect():
        by[r.source][0], by[r.source][1], by[r.source][2] = r.target, by[r.source][1] + r.taken, r.source_size
    assert all(abs(taken - target) <= max(64, 0.01 * target) for target, taken, _ in by.values())
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, _, s in by.values()))


def test_mix_copies_clashes_and_empty(spark):
    docs = [(1, "one two three", "s")] * 9000 + [(2, "x " * 50, "s"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'t' as target", "2 as n")
    got = mixing.mix(df, percent=50).collect()
    assert len(got) == len(docs)
    assert abs(sum(r.taken for r in got) - max(r.target for r in got)) < 64
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("text is null")).collect()} == {0}
