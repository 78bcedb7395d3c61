"""The merges of a rank file: one for each token, and none that byte pairs merged by rank would need is lost."""

import itertools
import random

import public_tokenizers

from tidemark.llm import bpe


def by_ranks(word, ranks):
    parts = [bytes([x]) for x in word]
    while len(parts) > 1:
        least, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if least == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def by_pairs(word, ranks, pairs):
    ids = [ranks[bytes([x])] for x in word]
    while len(ids) > 1:
        least, at = min((pairs.get(p, 1 << 30), i) for i, p in enumerate(itertools.pairwise(ids)))
        if least == 1 << 30:
            break
        ids[at : at + 2] = [least]
    return ids


def test_one_merge_for_each_token():
    random.seed(3)
    for _ in range(60):
        tokens = {bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(25)}
        ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *random.sample(sorted(tokens), len(tokens))])}  # some can't be reached by merges
        pairs = bpe.merge_pairs(ranks)
        assert len(set(pairs.values())) == len(pairs)
        for _ in range(60):
            word = bytes(random.choices(b"abc", k=random.randint(1, 12)))
            assert by_pairs(word, ranks, pairs) == by_ranks(word, ranks)


def test_tables_hold_no_other_pairs():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANK_FILE))
    pairs = bpe.merge_pairs(ranks)
    assert len(pairs) == len(set(pairs.values())) == len(ranks) - 256
