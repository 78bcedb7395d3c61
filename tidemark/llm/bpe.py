"""Byte-level BPE: encoding by folds over the bytes of distinct words, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Longer words are merged with a heap in the task instead: a fold takes time in the square of the length.
MAX_FOLD_BYTES = 256
#: Distinct words that a task remembers before it starts anew.
MAX_WORDS = 400_000
#: Pieces of text between spaces whose words a task remembers; others are split again.
MAX_PIECES = 120_000
#: Texts, and about so many characters of them, that are encoded at once.
TEXTS, CHARS = 500, 2_000_000
#: White space as the tokenizer's pattern means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No rank; a token of a fold is a number of its pair's rank, its place in the word and its id, of so many bits.
NO_RANK, PLACE_BITS, ID_BITS = 2**17 - 1, 9, 17


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that each mergeable pair of ids becomes; it is also the rank of the merge.

    Of a token's pairs that is the one which merges over its own bytes leave last.  Merges around a pair
    do not change the order of those within it, so no other pair of the token is ever met.
    """
    pairs = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, at = min((ranks.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if least == NO_RANK:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return pairs


def _prime(least: int) -> int:
    n = least | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


@functools.lru_cache(maxsize=2)
def rank_tables(path: str) -> tuple[int, int, str, str, str]:
    """The merges as a perfect hash of pairs, made once a session: two moduli and three tables as JSON.

    The slot of a pair's key is (key + shifts[key mod m]) mod n; ``slots`` holds the key and the
    rank, or 0.  The third table has the ranks of pairs of single bytes.
    """
    ranks = load_ranks(path)
    if sorted(r for t, r in ranks.items() if len(t) == 1) != list(range(256)) or max(ranks.values()) >= 65_536:
        raise ValueError("the ranks 0 to 255 are to be the single bytes, and all to be below 65,536")
    keys = {a << 16 | b: r for (a, b), r in merge_pairs(ranks).items()}
    m, n = _prime(len(keys) * 2 // 5 + 65_536), _prime(len(keys) * 3 // 2 + 65_536)  # m * n exceeds all keys, so that some shift parts any two
    held: dict[int, list[int]] = {}
    for key in keys:
        held.setdefault(key % m, []).append(key)
    slots, shifts, shift = [0] * n, [0] * m, 0
    for place, own in sorted(held.items(), key=lambda x: -len(x[1])):
        while any(slots[(k + shift) % n] for k in own):
            shift = (shift + 7919) % n
        shifts[place] = shift
        for k in own:
            slots[(k + shift) % n] = k << ID_BITS | keys[k]
    if 0 not in keys and not slots[shifts[0] % n]:
        slots[shifts[0] % n] = 1 << 62  # the pair of key 0 is no merge
    single = {r: t for t, r in ranks.items() if len(t) == 1}
    pairs = [ranks.get(single[a] + single[b], NO_RANK) for a in range(256) for b in range(256)]
    return m, n, *(json.dumps(x, separators=(",", ":")) for x in (slots, shifts, pairs))


def fold_word(word: Column, ranks_path: str) -> Column:
    """Folds ranked merges over one word, an array of ids of single bytes, by a literal rank map.

    The state is the word's tokens between two sentinels, each one number: the rank of the pair that
    it begins, its place and its id.  The least number is the leftmost pair of the lowest rank; a
    step merges it, so that a step for each byte but one is enough, and looks up two ranks.  A
    word of one id of any kind is returned as it is.
    """
    m, n, *tables = rank_tables(ranks_path)
    slots, shifts, byte_pairs = (F.from_json(F.lit(t), "array<bigint>") for t in tables)

    def long(x: int) -> Column:
        return F.lit(x).cast("bigint")

    rank_at, one = ID_BITS + PLACE_BITS, F.lit(1)
    none, ids, low = long(NO_RANK), long(2**ID_BITS - 1), long(2**rank_at - 1)
    places, far = long(2**rank_at - 2**ID_BITS), long(2**PLACE_BITS - 1)

    def rank(key: Column) -> Column:
        slot = (key + F.get(shifts, (key % long(m)).cast("int"))) % long(n)
        return F.least(none, F.get(slots, slot.cast("int")).bitwiseXOR(F.shiftleft(key, ID_BITS)))  # another key leaves a bit above the rank

    def looked_up(x: Column) -> Column:
        return F.shiftleft(rank(F.shiftright(x, rank_at)), rank_at).bitwiseOR(x.bitwiseAND(low))

    def merged(tokens: Column, least: Column) -> Column:
        at = F.shiftright(least, ID_BITS).bitwiseAND(far).cast("int")
        left, new = F.get(tokens, at - 1), F.shiftright(least, rank_at)
        before = F.shiftleft(left.bitwiseAND(ids), rank_at + 16).bitwiseOR(F.shiftleft(new, rank_at)).bitwiseOR(left.bitwiseAND(low))
        after = F.shiftleft(new, rank_at + 16).bitwiseOR(F.shiftleft(F.get(tokens, at + 2).bitwiseAND(long(65_535)), rank_at)).bitwiseOR(least.bitwiseAND(places)).bitwiseOR(new)
        rest = F.transform(F.slice(tokens, at + 3, F.size(tokens)), lambda x: x - long(2**ID_BITS))
        return F.flatten(F.array(F.slice(tokens, one, at - 1), F.transform(F.array(before, after), looked_up), rest))

    def step(tokens: Column, _: Column) -> Column:
        done = long(NO_RANK << rank_at)
        return F.get(F.transform(F.array(F.array_min(tokens)), lambda least: F.when(least >= done, tokens).otherwise(merged(tokens, least))), 0)

    def token(x: Column, i: Column) -> Column:
        own = F.coalesce(F.get(byte_pairs, (x * 256 + F.get(word, i + 1)).cast("int")), none)
        return F.shiftleft(own, rank_at).bitwiseOR(F.shiftleft(i.cast("bigint") + 1, ID_BITS)).bitwiseOR(x)

    first, last = F.array(long(NO_RANK << rank_at | NO_RANK)), F.array(long(NO_RANK << rank_at | (2**PLACE_BITS - 1) << ID_BITS | NO_RANK))
    start = F.flatten(F.array(first, F.transform(word, token), last))
    return F.aggregate(F.slice(word, F.lit(2), F.size(word)), start, step, lambda t: F.transform(F.slice(t, F.lit(2), F.size(t) - 2), lambda x: x.bitwiseAND(ids)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a very long word, by a heap of its pairs."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i and ends at end[i]
    alive = [True] * n

    def push(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        push(i)
        push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _pieces(pattern: str):
    """A function that gives the words of a text, and remembers those of its pieces.

    Where each space is followed by other than white space, the text between two spaces can be
    split by itself, so that it is split once.
    """
    import regex

    words = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
    return words, re.compile(r" (?:\s|\Z)").search


def _numbered(ranks_path: str, pattern: str):
    """Texts as numbers of their words, each batch after a row of the words that are new in this task.

    A new word is the ids of its bytes; a token, or a word too long to fold, its ids in ``done``.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ranks, (split, odd) = load_ranks(ranks_path), _pieces(pattern)
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        longs = pa.list_(pa.list_(pa.int64()))
        kinds = pa.schema([("row", pa.int64()), ("words", pa.list_(pa.int32())), ("bytes", longs), ("done", longs), ("anew", pa.bool_())])
        numbers: dict[str, int] = {}
        fresh: list[str] = []

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                own = tuple(numbered(" " + piece))
                if len(self) < MAX_PIECES:
                    self[piece] = own
                return own

        def numbered(text: str) -> list[int]:
            out = []
            for w in split(text):
                if (number := numbers.get(w)) is None:
                    number = numbers[w] = len(numbers)
                    fresh.append(w)
                out.append(number)
            return out

        def coded(text: str | None) -> np.ndarray:
            if not text:
                return np.empty(0, np.int32)
            if odd(text):
                return np.array(numbered(text), np.int32)
            first, *rest = text.split(" ")
            return np.array([*numbered(first), *itertools.chain.from_iterable(map(pieces.__getitem__, rest))], np.int32)

        def lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))

        def new_words(anew: bool) -> Iterator:
            """Folded words come first: the numbers of a batch's words are dealt again in that order."""
            for at in range(0, max(len(fresh), 1), 20_000):
                part = [w.encode() for w in fresh[at : at + 20_000]]
                fold = [w if w not in ranks and len(w) <= MAX_FOLD_BYTES else b"" for w in part]
                done = [[] if f else [ranks[w]] if w in ranks else merge_long(w, ranks) for w, f in zip(part, fold, strict=True)]
                columns = [
                    lists(single[np.frombuffer(b"".join(fold), np.uint8)], [len(w) for w in fold]),
                    lists(np.fromiter(itertools.chain.from_iterable(done), np.int64), [len(x) for x in done]),
                ]
                whole = pa.array([0, len(part)], pa.int32())
                columns = [pa.ListArray.from_arrays(whole, c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kinds.field(1).type), *columns, pa.array([anew and at == 0])], schema=kinds)

        pieces, anew = Pieces(), False
        for whole in batches:
            for rows, texts in _parts(whole):
                if len(numbers) > MAX_WORDS:
                    numbers.clear()
                    pieces.clear()
                    anew = True
                out = [coded(t) for t in texts]
                if fresh or anew:
                    yield from new_words(anew)
                    fresh.clear()
                    anew = False
                n = len(out)
                yield pa.RecordBatch.from_arrays([rows, lists(np.concatenate(out), [len(x) for x in out]), pa.nulls(n, longs), pa.nulls(n, longs), pa.nulls(n, pa.bool_())], schema=kinds)

    return run


def _parts(batch) -> Iterator[tuple]:
    """The ids and the texts of a batch, in parts of bounded size."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, np.concatenate(([0], np.cumsum(lengths)))
    while at < batch.num_rows:
        end = min(at + TEXTS, max(at + 1, int(np.searchsorted(total, total[at] + CHARS, "right")) - 1), batch.num_rows)
        part = batch.slice(at, end - at)
        yield part.column(0), part.column(1).to_pylist()
        at = end


def _joined(batches) -> Iterator:
    """Texts as the ids of their words, which came before them in the same task."""
    import numpy as np
    import pyarrow as pa

    ids, ends, n = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    def grown(x: np.ndarray, size: int) -> np.ndarray:
        return x if size <= len(x) else np.concatenate([x, np.empty(max(size - len(x), len(x)), x.dtype)])

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        inner = column.flatten()
        return inner.flatten().to_numpy(zero_copy_only=False), np.diff(inner.offsets.to_numpy())

    for batch in batches:
        is_text = np.asarray(batch.column("words").is_valid())
        cuts = [0, *(np.flatnonzero(is_text[1:] != is_text[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(cuts):
            part = batch.slice(start, end - start)
            if start < batch.num_rows and not is_text[start]:
                for i in range(part.num_rows):
                    row = part.slice(i, 1)
                    if row.column("anew")[0].as_py():
                        n = 0
                    (folded, sizes), (done, done_sizes) = flat(row.column("bytes")), flat(row.column("done"))
                    both = sizes + done_sizes
                    base, count = int(ends[n]), len(both)
                    ids, ends = grown(ids, base + int(both.sum())), grown(ends, n + count + 1)
                    new_ends = base + np.cumsum(both)
                    own, of_fold = ids[base : base + int(both.sum())], np.repeat(sizes > 0, both)
                    own[of_fold], own[~of_fold] = folded, done
                    ends[n + 1 : n + 1 + count] = new_ends
                    n += count
                continue
            numbers, words = part.column("words").flatten().to_numpy(zero_copy_only=False), part.column("words").offsets.to_numpy()
            begins, lengths = ends[numbers], ends[numbers + 1] - ends[numbers]
            total = np.concatenate(([0], np.cumsum(lengths)))
            values = ids[np.repeat(begins - total[:-1], lengths) + np.arange(total[-1])]
            offsets = total[words - words[0]]
            raw = pa.py_buffer(values.astype("<u4").tobytes())
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32))), binary], names=["row", "ids", "ids_le"]
            )


def encode(
    docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes texts with byte-level BPE, each match of ``pattern`` separately, no special tokens.

    Three steps run in one stage, without a shuffle: the task numbers the words of its texts,
    Spark's higher-order functions fold the ranked merges over the bytes of each word that is new
    to the task by a literal rank map, and the task puts the ids of words in the place of their
    numbers.  It remembers ``MAX_WORDS`` words at most and then starts anew.  A word that is a
    token needs no merges, and one longer than ``MAX_FOLD_BYTES`` bytes is merged with a heap, to
    the same ids.

    Returns (id_col, ids array<int>, ids_le binary: the ids as little-endian unsigned 32-bit
    integers), a row for each input row.  Null and empty texts have no ids; null and repeated ids
    are kept; other columns are left out.  ``ranks_path`` must be readable on the executors.
    """
    ranks_path = ranks_path or public_tokenizers.path(RANK_FILE)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"))
    numbered = rows.mapInArrow(_numbered(ranks_path, pattern), "row bigint, words array<int>, bytes array<array<bigint>>, done array<array<bigint>>, anew boolean")
    folded = numbered.select("row", "words", F.transform("bytes", lambda w: fold_word(w, ranks_path)).alias("bytes"), "done", "anew")
    return folded.mapInArrow(_joined, "row bigint, ids array<int>, ids_le binary").withColumnRenamed("row", id_col)


@functools.lru_cache(maxsize=2)
def token_pieces(path: str) -> str:
    """The bytes of all tokens in the order of their ids, as JSON."""
    ranks = load_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return json.dumps([base64.b64encode(p).decode() for p in pieces], separators=(",", ":"))


def decode(ids: Column, ranks_path: str | None = None) -> Column:
    """The bytes of an array of ids: their binary pieces from one literal, concatenated.

    A null array gives null; ids that are null or not in the vocabulary add no bytes.
    """
    # A cast between bytes and strings changes no byte, and strings are what Spark joins in one go.
    literal = F.from_json(F.lit(token_pieces(ranks_path or public_tokenizers.path(RANK_FILE))), "array<binary>").cast("array<string>")
    return F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "").cast("binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return digests(encode(table(spark, sf_dir, "documents")))


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
