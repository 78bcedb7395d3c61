"""Tiles of large buckets: every pair that may agree meets, and rows do not grow with the square of a group."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import near


def buckets(spark, rows):
    return spark.createDataFrame(rows, "key long, id long, n int, component long").repartition(3)


def test_all_pairs_apart_meet(spark):
    random.seed(9)
    rows, i = [], 0
    for key, size, share in ((1, 300, 0.0), (2, 200, 0.9), (3, 20, 0.5), (4, 100, 1.0), (5, 17, 0.0)):
        for _ in range(size):
            i += 1
            rows.append((key, i, random.choice([4, 5, 8, 10, 100, 125]) if key == 1 else random.randint(1, 300), 0 if random.random() < share else i))
    tiles = defaultdict(list)
    for r in near._apart_tiles(buckets(spark, rows), 16, 0.8).collect():
        tiles[r.key, r.i, r.j].append(r)
    met, seen = set(), defaultdict(int)
    for tile in tiles.values():
        assert sum(r.query for r in tile) <= 48 and sum(r.target for r in tile) <= 48
        for a in tile:
            for b in tile:
                if a.query and b.target and a.component != b.component:
                    met.add((a.key, min(a.id, b.id), max(a.id, b.id)))
                    if a.alone or b.alone or b.id > a.id:
                        seen[a.key, min(a.id, b.id), max(a.id, b.id)] += 1
    wanted = set()
    for x, (key, a, n, c) in enumerate(rows):
        for other, b, m, d in rows[x + 1 :]:
            if other == key and c != d and max(n, m) - min(n, m) <= int(0.2 * max(n, m) + 1e-9):
                wanted.add((key, a, b))
    assert wanted <= met and all(seen[p] for p in wanted)
    assert not any(k == 4 for k, _, _ in tiles)  # one component


def test_tiles_of_one_large_group_grow_with_it(spark):
    for size in (500, 2000):
        same = [(1, i, 50, 0) for i in range(size)]
        few = [(1, size + i, 50, size + i) for i in range(5)]
        assert near._star_tiles(buckets(spark, same), 100).count() == size + size // 100 - 1
        assert near._apart_tiles(buckets(spark, same), 100, 0.8).count() == 0
        assert near._apart_tiles(buckets(spark, same + few), 100, 0.8).count() <= 1.2 * size


def test_buckets_of_one_component_make_no_rows(spark, monkeypatch):
    """Of a component that has most of a large bucket only bands that another text visits go on; small buckets of one component do not."""
    made, real = {}, near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    small = [(1, i, 50, 0) for i in range(50)]
    large = [(2, i, 50, 0) for i in range(100, 500)] + [(2, i, 300, 0) for i in range(500, 520)]
    rows = near._apart_tiles(buckets(spark, [*small, *large, (2, 600, 310, 600), (2, 601, 900, 601)]), 100, 0.8).collect()
    assert not [r for r in rows if r.key == 1]
    assert made["visits"].count() == 6 and made["main"].count() == 20
    assert {r.id for r in rows if r.target} == {600, 601, *range(500, 520)}


def test_wider_tiles_are_parted_where_texts_agree():
    """Each pair that agrees meets once, in tiles of ``tile`` texts a side at most."""
    rng = np.random.default_rng(4)
    size, tile = 90, 16
    kinds = rng.integers(1, 255, (6, near.BINS))
    ids, n, kind = np.arange(size) * 7 % 101, rng.choice([40, 45, 50, 90], size), rng.integers(0, 6, size)
    component, alone, query = np.where(rng.random(size) < 0.3, 0, ids), rng.random(size) < 0.2, rng.random(size) < 0.9
    signatures = [np.where(rng.random(near.BINS) < 0.1, 0, kinds[k]).astype(np.uint8).tobytes() for k in kind]
    for target in (np.ones(size, bool), rng.random(size) < 0.7):
        columns = {"key": np.full(size, 5), "i": np.full(size, 3, np.int32), "j": np.full(size, 2, np.int32), "id": ids, "n": n.astype(np.int32)}
        columns |= {"signature": signatures, "component": component, "query": query, "target": target, "alone": alone}
        tiles = defaultdict(list)
        large = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})
        large = pa.RecordBatch.from_arrays(large.columns, schema=pa.schema([f.with_nullable(False) for f in large.schema]))
        few = large.slice(0, 8).set_column(0, large.schema.field(0), pa.array(np.full(8, 4)))
        out = list(near._apart(0.8, tile)(iter([few, large])))
        assert len({str(b.schema) for b in out}) == 1
        for batch in out:
            for r in batch.to_pylist():
                if r["key"] == 5:
                    tiles[r["key"], r["i"], r["j"]].append(r)
        seen, place = defaultdict(int), {int(x): k for k, x in enumerate(ids)}
        agree = lambda a, b: near._agree(n, np.array([list(x) for x in signatures], np.uint8), np.array([a]), np.array([b]), 0.8)[0]
        for rows in tiles.values():
            assert sum(r["query"] for r in rows) <= tile and sum(r["target"] for r in rows) <= tile
            for a in rows:
                for b in rows:
                    if a["query"] and b["target"] and (a["alone"] or b["alone"] or b["id"] > a["id"]):
                        seen[place[a["id"]], place[b["id"]]] += 1
        wanted = {(a, b) for a in range(size) for b in range(size) if query[a] and target[b] and component[a] != component[b] and (alone[a] or alone[b] or ids[b] > ids[a]) and agree(a, b)}
        assert len(tiles) > 2 and len(wanted) > 50 and all(seen[p] == 1 for p in wanted)


def test_texts_of_a_bucket_go_once_to_a_wider_tile(spark, monkeypatch):
    """Different texts with a phrase in common are each sent once to be compared, up to ``WIDER`` tiles."""
    dealt, real = [], near._apart_tiles
    monkeypatch.setattr(near, "_apart_tiles", lambda *a: dealt.append(real(*a).collect()) or real(*a))
    rows = [(i, " ".join([f"w{i}x{j}" for j in range(3)] + ["one two three"] + [f"v{i}x{j}" for j in range(3 + i % 3)])) for i in range(50)]
    assert near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=16).where("kept").count() == 50
    assert len(dealt[0]) == 50 and len({r.id for r in dealt[0]}) == 50


def test_texts_without_one_of_their_length_are_not_dealt(spark, monkeypatch):
    """Of texts with a phrase in common those go on, without signatures, that may agree with one of another component."""
    dealt, real = [], near._apart_tiles
    monkeypatch.setattr(near, "_apart_tiles", lambda rows, *a: dealt.append(rows) or real(rows, *a))
    rows = [(i, " ".join([f"w{i}x{j}" for j in range(3)] + ["one two three"] + [f"v{i}x{j}" for j in range(n - 6)])) for i, n in enumerate((8, 20, 60, 75, 200))]
    assert near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count() == 5
    assert {r.id for r in dealt[0].collect()} == {2, 3} and "signature" not in dealt[0].columns


def test_all_that_may_agree_are_within_reach(spark):
    random.seed(5)
    rows = [(key, 1000 * key + i, random.randint(1, 400), random.choice([0, 1, 1000 * key + i])) for key in range(40) for i in range(key % 7 + 1)]
    for least in (0.5, 0.8, 0.95):
        kept = {(r.key, r.id) for r in near._within_reach(buckets(spark, rows), least).collect()}
        wanted = {(k, a) for k, a, n, c in rows for q, b, m, d in rows if k == q and c != d and abs(n - m) <= int((1 - least) * max(n, m) + 1e-9)}
        assert wanted <= kept and len(kept) < len(rows)
