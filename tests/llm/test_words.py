"""Words found and hashed in bulk, against plain splitting."""

import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import passages

SPACES = [" ", "\t", "\n", "\x0b", "\f", "\r", "  ", "\x1c", " ", ""]


def _texts(rng):
    words = ["a", "bc", "ab", "ba", "é", "日本", "x" * 9, "."]
    return ["".join(rng.choice(words) + rng.choice(SPACES) for _ in range(rng.choice([0, 1, 3, 60]))) for _ in range(rng.randint(0, 9))]


def test_words_equal_the_pattern():
    rng, seen = random.Random(2), {}
    for _ in range(200):
        texts = _texts(rng)
        hashes, bounds, raw, begins, ends = passages._together([t.encode() for t in texts])
        got = [[raw[a:b].decode() for a, b in zip(begins[i:j], ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
        for word, value in zip([w for words in got for w in words], hashes.tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_anchors_of_many_texts_equal_those_of_each(monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", 4000)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 5, 34, 35, 36, 90, 3000]))) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(range(120)), pa.array([t or None for t in texts])], names=["k1", "k2", "text"])
    rows = pa.Table.from_batches(list(passages._anchors(35, 3)([batch]))).to_pylist()
    want = []
    for i, text in enumerate(texts):
        words, bounds, *_ = passages._together([text.encode()])
        starts, sizes, anchors, weights = passages.anchored(words, bounds, 35, 3)
        assert sizes.sum() == max(0, len(words) - 34)
        want += [(i, s, a, w) for s, a, w in zip(starts.tolist(), anchors.view(np.int64).tolist(), weights.tolist(), strict=True)]
    assert [(r["k1"], r["start"], r["anchor"], r["weight"]) for r in rows] == want
