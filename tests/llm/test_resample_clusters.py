"""Importance resampling and centroid clustering against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from test_corpus import TEXTS, texts

from tidemark.llm import centroids, resample

TARGET = ["i m foo bar w1 w2", None, "", "w3\nw4 w5 W6\nabc"]


def features(text, gram):
    words = re.findall(resample.WORD, (text or "").translate(str.maketrans(resample.UPPER, resample.LOWER)))
    return words, [" ".join(words[i : i + n]) for n in range(1, gram + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, gram, buckets, percent, least, seed=resample.SEED):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(b, features(x, gram)[1]))
    for x in target:
        t.update(map(b, features(x, gram)[1]))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        words, found = features(x, gram)
        weight = sum(gain(b(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r, place.get(id(r))] for r in out), key=str)


def test_resample_equals_plain_python(spark):
    rows = TEXTS + [(40 + i, "\n".join(f"W{(i + j) % 9} x{j}" for j in range(12))) for i in range(12)] + [(60, "one\n\n \n;\ntwo\nthree four\n")]
    target = spark.createDataFrame([(k, x, "own") for k, x in enumerate(TARGET)], "item_id long, text string, row string")
    for gram, least in ((1, 5), (2, 1), (3, 4)):
        df = resample.resample(texts(spark, rows), target, percent=50, min_words=least, gram=gram, buckets=97)
        got = sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()), key=str)
        assert got == brute(rows, TARGET, gram, 97, 50, least)


def test_resample_without_rows(spark):
    none = texts(spark, [])
    assert resample.resample(none, none.select("text")).count() == 0
    got = resample.resample(texts(spark, [(1, "a b"), (1, "a b"), (2, None)]), none.select("text"), percent=100, min_words=1).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"] or 0) for r in got) == [(1, 2, 1), (1, 2, 2), (2, 0, 0)]


def lloyd(rows, k, rounds, seed, scale):
    x = [(i, [math.floor(float(c) * scale) for c in v]) for i, v in rows]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda j: (dist(v, cents[j]), j)) for _, v in x]
        if r < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), o in zip(x, own, strict=True) if o == j]
                if mine:
                    cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    d = [dist(v, cents[o]) for (_, v), o in zip(x, own, strict=True)]
    inertia = Counter()
    for o, e in zip(own, d, strict=True):
        inertia[o] += e
    return sorted((-1 if i is None else i, o, e, inertia[o], sum(d), hashlib.sha256(",".join(map(str, cents[o])).encode()).hexdigest()) for (i, _), o, e in zip(x, own, d, strict=True))


def test_clusters_equal_full_scans(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(6, 8)) * 3
    good = [(i, (spots[i % 6] + rng.normal(size=8)).tolist()) for i in range(240)] + [(500, [1.0] * 8)] * 3 + [(None, [0.25] * 8), (7, [-2.0] * 8)]
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [None] + [1.0] * 7), (905, [float("inf")] * 8)]
    for k, rounds in ((1, 2), (5, 0), (5, 6), (9, 4), (400, 2)):
        df = spark.createDataFrame([(i, v, "own") for i, v in good + bad], "vec_id long, embedding array<double>, cluster string")
        got = centroids.cluster(df, clusters=k, rounds=rounds, scale=4, dimensions=8).collect()
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == lloyd(good, k, rounds, 1, 4)
        if (k, rounds) == (5, 6):  # the bounds spare most distances once centroids settle
            assert sum(r.evaluated for r in got) < 0.6 * k * len(got)


def test_clusters_of_large_components(spark):
    good = [(i, [float((i * 7919 + j * 104729) % 100_003) * 1000, -float(i) * 1000]) for i, j in ((a, a % 5) for a in range(60))]
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    got = centroids.cluster(df, clusters=4, rounds=3, scale=1, dimensions=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == lloyd(good, 4, 3, 1, 1)
    huge = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    try:
        centroids.cluster(huge, dimensions=1).collect()
    except Exception as e:
        assert "squared distances" in str(e)
    else:
        raise AssertionError("not refused")
    assert centroids.cluster(df.limit(0)).count() == 0


def test_total_displacement_bounds_are_tighter():
    """A centroid that goes out and comes back loosens nothing; every bound stays below the true distance."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, size=(300, 6))
    c0 = rng.integers(-50, 50, size=(5, 6))
    away = c0 + rng.integers(-30, 30, size=c0.shape)
    b = centroids.first_assignment(x, c0)
    b, _ = centroids.next_assignment(x, np.stack([c0, away]), b)
    assert (b.cluster == centroids.squared(x, away).argmin(1)).all()
    start = centroids.first_assignment(x, c0)
    back, taken = centroids.next_assignment(x, np.stack([c0, away, c0]), start)
    assert (back.cluster == start.cluster).all() and taken.sum() < 0.2 * len(x)
