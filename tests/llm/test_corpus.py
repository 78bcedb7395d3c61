import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import database, same
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import bpe, catalog, lattice, lines, mixing, mtree, near, passages, quality, tokenfile, warc
from tidemark.llm.common import connected_components, new_path

LONG = "x" * 3000 + " " + "abcdefgh" * 500
TEXTS = [
    (1, None), (2, ""), (3, " a  b\n \nc \n\n  d e f　x. "), (4, LONG), (5, "I'm it's\x1c\x1dfoo \x1c bar ́e\n Straße, ΣΑΣ."),
    (6, "日本語 \U0001f600a"), (7, "The " * 100), (7, "The " * 100), (None, "no id at all"), (8, " ".join(f"w{i}" for i in range(60))), (9, " ".join(f"w{i}" for i in range(1, 61))),
]


def texts(spark, rows=TEXTS):
    """Documents with an extra column whose name clashes with names that operators add."""
    return spark.createDataFrame([(i, t, "en", "s" if (i or 0) % 2 else None, len(t or ""), "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copy string")


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE_SQL[name])


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 10), (None, 4)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8}
    assert connected_components(e.limit(0)).count() == 0


def test_mixing(spark):
    out = mixing.mix_sources(texts(spark), epochs=3.0).collect()
    assert out and {"copy", "shuffle_key", "text"} <= set(out[0].asDict())
    assert max(Counter((r.doc_id, r.copy) for r in out).values()) <= 2
    assert {r.source for r in mixing.mix_sources(texts(spark), {"s": 1.0}, epochs=3.0).collect()} <= {"s"}
    assert mixing.mix_sources(texts(spark, [])).count() == 0
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    n = Counter(r.source for r in mixing.mix_sources(big).select("source").collect())
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200


def poisson_draws(rate, ident, seed=mixing.SEED):
    """The copies of a document of a rate, by plain Python: a draw for each part of the rate."""
    parts = max(1, math.ceil(rate / mixing.MAX_RATE))
    rate /= parts
    steps, total, log_p = [], 0.0, 0.0
    for k in range(math.ceil(rate + 12 * math.sqrt(rate) + 40) + 1):
        log_p += math.log(rate) - math.log(k) if k else -rate
        total += math.exp(log_p)
        steps.append(total)
    out = []
    for part in range(parts):
        name = f"{seed}:{ident}" if not part else f"{seed}:part:{part}:{ident}"
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        out += [part * len(steps) + k for k in range(sum(c <= u for c in steps))]
    return out


def test_large_rates_are_drawn_in_parts(spark):
    # Two texts stand for half of the characters; the rates are far beyond one draw's.
    rows = [(i, "y" * 3999, "large") for i in range(20)] + [(100, "z", "small"), (101, "", "small"), (102, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_group", F.lit(7)).withColumn("_part", F.lit(8))
    sizes = {"large": 80_000, "small": 3, None: 1}
    out = mixing.mix_sources(docs).collect()
    got = {}
    for r in out:
        assert r._group == 7 and r._part == 8
        got.setdefault(r.doc_id, []).append(r.copy)
    for i, _, source in rows:
        assert sorted(got.get(i, [])) == poisson_draws(sum(sizes.values()) / 3 / sizes[source], i)
    # The deviation of so many copies is a few hundred.
    assert abs(len(got[102]) - 80_004 / 3) < 1000 and abs(len(got[100]) - 80_004 / 9) < 600
    halves = mixing.poisson_steps(spark.createDataFrame([("a", 1e9), ("b", 256.0), ("c", 0.0)], "source string, rate double")).collect()
    assert {r.source: r.parts for r in halves} == {"a": 3_906_250, "b": 1} and max(len(r.cdf) for r in halves) < 600
    same(mixing.mix_sources(docs).select("doc_id", "source", "copy", "shuffle_key", "text"), tables(documents=rows), mixing.OP1_SQL)


def tables(**rows):
    """DuckDB with tables of documents."""
    con = duckdb.connect()
    for name, found in rows.items():
        con.execute(f"CREATE TABLE {name} (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", found)
    return con


def test_lines(spark):
    rows = [(i, f"head\nown {i}\n\nhead") for i in range(10)] + [(20, None), (21, "head")]
    got = {r.doc_id: r for r in lines.site_line_dedup(texts(spark, rows), max_ratio=0.5).collect()}
    assert got[2].text == "own 2\n" and got[2].n_dropped == 2 and got[20].text is None and got[20].n_lines == 0
    assert got[3].text == "own 3\n" and got[3].n_dropped == 2
    assert lines.site_line_dedup(texts(spark, [])).count() == 0


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path(bpe.RANK_FILE))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(texts(spark))
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(coded).collect()))
    want = []
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(texts(spark, [])).count() == 0
    word = b"abcab" * 30
    assert bpe.merge_long(word, ranks) == enc._encode_single_piece(word)


def test_token_files(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(tokenfile.TOKENIZER))
    path = new_path(spark, "tokens")
    rows = [x for x in TEXTS if x[0] != 7]
    tokenfile.write_tokens(texts(spark, rows), path, shard_tokens=50)
    got = {r.doc_id: (r.start, list(r.ids)) for r in tokenfile.read_tokens(spark, path).collect()}
    start = 0
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, ids)
        start += len(ids)
    ids = np.random.default_rng(0).integers(0, 20, 5000)
    shard = tokenfile.Shard(tokenfile.shard_bytes([1, None, 3], [ids[:10], ids[10:4000], ids[4000:]], 20))
    assert (shard.tokens(0, 5000) == ids).all() and (shard.tokens(333, 777) == ids[333:777]).all() and (shard.document(2) == ids[4000:]).all()
    assert len(shard.rules) and list(shard.has_id) == [True, False, True]


def pair_counts(symbols):
    """Occurrences of each pair of neighbours; those of equal symbols from the left without overlap."""
    counts, k = Counter(), 0
    for symbol, run in itertools.groupby(symbols):
        n = len(list(run))
        counts[symbol, symbol] += n // 2
        k += n
        if k < len(symbols):
            counts[symbol, symbols[k]] += 1
    return counts


def test_grammars_end_when_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    cases = [(rng.integers(0, k, int(n)), k) for k in (1, 2, 3, 5) for n in rng.integers(0, 400, 20)]
    cases += [(np.zeros(1000, np.int64), 1), (np.tile(rng.integers(0, 50, 500), 40), 50)]
    for ids, base in cases:
        for least in (2, 4):
            rules, lengths, symbols = tokenfile.compress(ids, base, least)
            assert max(pair_counts(symbols.tolist()).values(), default=0) < least
            assert (rules < base + np.arange(len(rules))[:, None]).all()
            assert (tokenfile.expand(symbols, rules, lengths, base) == ids).all()
            for k in range(0, len(rules), 7):
                assert len(tokenfile.expand(np.array([base + k]), rules, lengths, base)) == lengths[k]


def test_pieces_are_encoded_as_in_their_texts():
    import public_tokenizers as P

    encoder = tokenfile._Encoder(P.path(tokenfile.TOKENIZER))
    odd = ["abc'''s x'sy don't.'s \xe9'll$'m a.b,c!! x''", "ab" * 200 + "??", "\u0130stanbul.. \ufb01## </s> \xaa~~ <|endoftext|>.!", "a_b_ c__ (e) f)]'"]
    for text, ids in zip(odd, encoder(odd), strict=True):
        assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()
    assert max(map(len, encoder.known)) <= tokenfile.LONG_PIECE


def test_passages(spark):
    def brute(rows, window):
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
        seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
        out = []
        for (i, _), w in zip(rows, words, strict=True):
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if seen[tuple(w[k : k + window])] > 1:
                    gone[k : k + window] = [True] * window
            out.append((i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        return sorted(out)

    random.seed(3)
    base = [f"v{random.randint(0, 400)}" for _ in range(300)]
    rows = TEXTS + [(30 + i, " ".join(base[random.randint(0, 100) : random.randint(110, 300)] + [f"z{i}"] * 3)) for i in range(20)]
    for hot in (2, 4096):
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in passages.remove_repeats(texts(spark, rows), hot=hot).collect())
        assert got == brute(rows, 35)
    assert passages.remove_repeats(texts(spark, [])).count() == 0


def test_edit_distance():
    random.seed(4)
    for _ in range(300):
        a = [random.randint(0, 3) for _ in range(random.randint(0, 25))]
        b = [random.choice([x, x, x, 9]) for x in a if random.random() > 0.1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = random.randint(0, 10)
        assert near.edit_distance(a, b, most) == min(row[-1], most + 1)
        for least in (0.5, 0.8):
            assert near.similar(a, b, least) == (row[-1] <= (1 - least) * max(len(a), len(b)) + 1e-9)


def test_near_duplicates(spark):
    random.seed(5)
    base = [f"v{random.randint(0, 5000)}" for _ in range(200)]
    rows = [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(base[:50] + ["new"] + base[51:])), (103, " ".join(reversed(base))), (104, ""), (105, "  "), (106, None)]
    rows += [(200 + i, " ".join(base[: i + 1] + [f"q{i}"] + base[i + 2 :])) for i in range(20)]
    for tile in (4, 1024):
        got = {r.doc_id: (r.component_id, r.kept) for r in near.near_duplicates(texts(spark, rows), tile=tile).collect()}
        assert {got[i][0] for i in (100, 101, 102, *range(200, 220))} == {100}
        assert got[103] == (103, True) and got[105] == (104, False) and got[106] == (106, True)
    clashing = texts(spark, rows + [(103, rows[3][1])]).withColumns({c: F.lit(c) for c in ("gone", "twice", "n", "_gone", "node", "id")})
    left = near.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns
    left = left.collect()
    assert sorted(r.doc_id for r in left) == [100, 103, 104, 106] and {(r.gone, r.twice, r.n) for r in left} == {("gone", "twice", "n")}
    assert near.near_duplicates(texts(spark, [])).count() == 0


def grouped(rows):
    """Each text's group by aligning all pairs."""
    words = [t.split() for _, t in rows]
    group = {i: i for i, _ in rows}
    for x in range(len(rows)):
        for y in range(x):
            a, b = group[rows[x][0]], group[rows[y][0]]
            if a != b and near.similar(words[x], words[y], near.MIN_SIMILARITY):
                group = {i: min(a, b) if g in (a, b) else g for i, g in group.items()}
    return group


def test_near_duplicates_equal_all_pairs(spark):
    random.seed(8)
    rows = []
    for n in (5, 8, 15, 60, 200, 600):
        for similarity in (0.75, 0.8, 0.8, 0.84, 0.84, 0.88, 0.92, 1.0):
            base = [f"v{random.randint(0, 20000)}" for _ in range(n)]
            copy = list(base)
            for at in random.sample(range(n), round(n * (1 - similarity))):
                copy[at] = f"u{random.randint(0, 20000)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    base = [f"w{i}" for i in range(100)]
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(w if i % 5 != 2 else "new" for i, w in enumerate(base)))]
    for tile in (4, 1024):
        got = {r.doc_id: r.component_id for r in near.near_duplicates(texts(spark, rows), tile=tile).collect()}
        assert got == grouped(rows)


def test_near_duplicates_chains(spark):
    rows = []
    for g in range(60):
        base = [f"g{g}x{i}" for i in range(25)]
        rows += [(3 * g + k, " ".join(base[: 25 - 4 * k])) for k in range(3)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(texts(spark, rows)).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_lattice(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[200:] = x[0] + 0.15 * rng.normal(size=(100, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, x[5].astype(np.float32).tolist()), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids = [i for i, v in rows if i is not None and (i < 900 or i == 904)]
    m = np.array([v for i, v in rows if i in set(ids)], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    g = m @ m.T >= 0.9
    want = dict(zip(ids, (g.sum(1) - 1).tolist(), strict=True))
    component = list(range(len(ids)))  # the least place that links reach
    for _ in ids:
        component = [min(component[j] for j in np.flatnonzero(g[i])) for i in range(len(ids))]
    for tile in (16, 1024):
        got = {r.vec_id: r for r in lattice.embedding_links(df, tile=tile).collect()}
        found = sum(got[i].n_links for i in ids)
        assert 0.97 * sum(want.values()) <= found <= sum(want.values())
        # No vector has a link that is none, and only links near the bound may be missed.
        assert all(got[i].n_links <= want[i] for i in ids)
        assert [got[i].component_id for i in ids] == [ids[c] for c in component]
        assert all(got[i].kept == (got[i].component_id == i) for i in ids)
        assert got[904].component_id == 5 and not got[904].kept and got[902].n_links == 0 and got[900].kept and got[None].component_id is None
    q = lattice.nearest_e8(rng.normal(size=(100, 8)))
    assert ((q * 2) % 1 == 0).all() and (q.sum(1) % 2 == 0).all() and len(lattice.lattice_roots()) == 240


def test_mtree(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, size=(600, 8))
    x[300:] = x[:300]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None)], "id long, v array<bigint>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k_inner(df, df.where("id % 50 = 0"), tree=64, block=4).collect()}
    for i in range(0, 600, 50):
        best = sorted(((-int(x[i] @ x[j]), j) for j in range(600) if j != i))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert mtree.top_k_inner(df.limit(0), df).count() == 0


def test_mtree_odd_vectors(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (2, []), (3, None), (4, [5, None]), (5, [1, 1, 1]), (6, [2, 0, 1]), (None, [1, 1]), (50, [2, 2]), (50, [2, 2])]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k_inner(df, df).collect()}
    assert got[0, 1] == (1, 11) and got[0, 2] == (50, 6) and got[0, 3] == (50, 6) and (0, 4) not in got
    assert got[5, 1] == (6, 3) and got[50, 1] == (1, 14) and not any(q in (2, 3, 4) for q, _ in got)
    assert mtree.top_k_inner(df, df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/x", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "long " * 5000), (5, "u", "long " * 5000), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=1000, chunk_bytes=300)
    back = warc.read_warc(spark, path)
    assert back.where("error is not null").count() == 0
    got = {(r.page_id, r.payload_bytes): r for r in warc.resolved(back).collect()}
    assert got[2, 4].record_type == "response" and got[1, 4].refers_to == 2 and got[None, 4].refers_to == 2
    assert got[4, 0].record_type == "response" and got[3, 0].refers_to == 4 and got[5, 25000].record_type == "response"
    import base64

    assert got[1, 4].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = catalog.QUERIES["op10_quality_qda"](spark, DATA)
    seen = got.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in seen) >= 0.9 * len(seen) > 10
    # The same densities by plain numpy, from the labels that are not held out.
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    x = quality.statistics([texts_of[i] for i in known])
    y = np.array(list(known.values()))
    center, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-9))
    z = (x - center) / scale
    own = {c: np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)}
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    held = {r.doc_id: r.score for r in got.collect()}
    every = (quality.statistics([texts_of[i] for i in held]) - center) / scale
    logs = []
    for c in (0, 1):
        cov = (1 - quality.POOLED) * own[c] + quality.POOLED * pooled
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = every - z[y == c].mean(0)
        logs.append(np.log(((y == c).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))
    assert np.allclose(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), list(held.values()), atol=1e-6)
    assert quality.keep_quality(docs.limit(0), labels).count() == 0
    copies = quality.keep_quality(docs.union(docs), labels).groupBy("doc_id").count()
    assert {r["count"] for r in copies.collect()} == {2}
    assert got.where("score is null or score < 0 or score > 1").count() == 0 and got.count() == docs.count()
    assert all((r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)) for r in got.collect())
    assert quality.keep_quality(texts(spark), labels.limit(0)).count() == len(TEXTS)


def test_pipeline_stages(spark):
    """Each stage against a plain version of it, on what the stage before it kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "", "en", "src0", 0), (9004, "one\ntwo", "en", None, 7), (9004, "one\ntwo", "en", None, 7)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))

    def kept(name, docs):
        path = new_path(spark, name)
        out = stages[name](spark, docs, DATA)
        assert name == "bpe" or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(path)
        back = spark.read.parquet(path)
        return back, sorted(back.collect(), key=str)

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit_on(quality.feature_table(docs), labels)
    rows = docs.collect()
    good = [r for r, s in zip(rows, model.scores(quality.statistics([r.text for r in rows])), strict=True) if s >= quality.THRESHOLD]
    docs, got = kept("quality", docs)
    assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in sorted(good, key=str)] and 0 < len(got) < len(rows)

    hosts = {}
    for source, text in {(r.source, r.text) for r in got if r.text is not None}:
        hosts.setdefault(source, []).append({line for line in text.split("\n") if line.strip(" ")})
    dropped = {
        s: {line for line in set().union(*pages) if (n := sum(line in p for p in pages)) >= lines.MIN_PAGES and n > lines.MAX_RATIO * len(pages)} for s, pages in hosts.items()
    }
    want = [(r.doc_id, r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if x not in dropped[r.source])) for r in got]
    docs, got = kept("lines", docs)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str) and any(dropped.values())
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)

    group = grouped([(r.doc_id, r.text) for r in {r.doc_id: r for r in got if r.text is not None}.values()])
    want = {i for i, g in group.items() if i == g} | {r.doc_id for r in got if r.text is None}
    docs, got = kept("near_duplicates", docs)
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < len(group)

    before = {r.doc_id: r for r in got}
    docs, got = kept("mix", docs)
    assert all(before[r.doc_id] == r for r in got)
    assert {r.doc_id: r.n_tokens for r in stages["bpe"](spark, docs, DATA).select("doc_id", "n_tokens").distinct().collect()}.keys() == {r.doc_id for r in got}
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANK_FILE)), special_tokens={})
    ids = {r.doc_id: enc.encode_ordinary(r.text or "") for r in got}
    _, coded = kept("bpe", docs)
    assert len(coded) == len(got)
    for r in coded:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(struct.pack(f"<{len(ids[r.doc_id])}I", *ids[r.doc_id])).hexdigest())
    for name, stage in stages.items():
        assert stage(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(0), DATA).count() == 0, name
