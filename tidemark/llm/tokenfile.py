"""Token ids in a grammar-compressed file format with random access."""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import new_path, partitions, stored, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Tokens after which a shard ends; a document is never cut.
SHARD_TOKENS = 1 << 20
#: A pair becomes a rule if it occurs so often: a rule takes 12 bytes and an occurrence saves 4.
LEAST = 4
#: Pieces of text whose ids a Python worker remembers, none of more characters than ``LONG_PIECE``.
MAX_REMEMBERED = 1_000_000
LONG_PIECE = 64

_MAGIC = b"TDRP"
_HEAD = struct.Struct("<4sHHIIIIQ")  # magic, version, 0, first rule's id, rules, symbols, documents, tokens


# --- the grammar -----------------------------------------------------------------------------


def _mixed(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(32))


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in ascending order, and the place that each came from."""
    own = len(key).bit_length()
    if bits + own > 63:
        order = np.argsort(key)
        return key[order], order
    # Sorting numbers that end in their place is several times faster than sorting places.
    both = np.sort((key << own) | np.arange(len(key)))
    return both >> own, both & ((1 << own) - 1)


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over ids below ``base``: (rules as pairs, their expansion lengths, sequence).

    It ends when no pair of neighbours occurs ``least`` times; occurrences of a pair of equal
    symbols are counted from the left without overlap.  Each round replaces all occurrences of a
    pair that are more frequent than the occurrences they overlap with, so the most frequent pair
    is always replaced whole.  A pair that has become rare cannot become frequent again unless a
    new symbol is in it, so a queue holds the places of frequent pairs and of neighbours of new
    symbols, and a round reads no other place.  Rule k is id base + k and refers to earlier ids only.
    """
    least = max(least, 2)
    n = len(ids)
    # Neighbours by place; places -1 and n, kept at the end, are outside of the sequence.
    seq, right, left = np.full(n + 2, -1, np.int32), np.full(n + 2, n, np.int32), np.full(n + 2, -1, np.int32)
    seq[:n], right[:n], left[:n] = ids, np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.append(np.ones(n, bool), [False, False])
    # Rank of the pair that starts at a place, 0 for places out of the queue.
    rank, queued = np.zeros(n + 2, np.int32), np.zeros(n + 2, bool)
    rules, n_rules = [np.empty((0, 2), np.int64)], 0
    queue = np.arange(max(n - 1, 0))
    while len(queue) >= least:
        bits = (base + n_rules).bit_length()
        first, second = seq[queue], seq[right[queue]]
        ordered, order = _sorted((first.astype(np.int64) << bits) | second, 2 * bits)
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        pair = np.empty(len(queue), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        pairs = ordered[new]
        # In a run of equal symbols every second place counts.
        counted = np.ones(len(queue), bool)
        same = np.flatnonzero(first == second)
        if len(same):
            at, kind = queue[same], first[same]
            begins = np.concatenate(([True], (right[at[:-1]] != at[1:]) | (kind[1:] != kind[:-1])))
            number = np.arange(len(at))
            counted[same] = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
        counts = np.bincount(pair[counted], minlength=len(pairs))
        frequent = np.flatnonzero(counts >= least)
        if not len(frequent):
            break
        ranks = np.zeros(len(pairs), np.int32)
        by_count = np.lexsort((_mixed(pairs[frequent]), counts[frequent]))
        ranks[frequent[by_count]] = np.arange(1, len(frequent) + 1)
        live = ranks[pair] > 0
        queue, pair, counted = queue[live], pair[live], counted[live]
        own = ranks[pair]
        rank[queue] = own
        chosen = counted & (own >= rank[left[queue]]) & (own >= rank[right[queue]])
        rank[queue] = 0
        used = np.bincount(pair[chosen], minlength=len(pairs))
        made = used >= least
        chosen &= made[pair]
        ids_of = np.cumsum(made) - 1 + base + n_rules
        rules.append(np.stack([pairs[made] >> bits, pairs[made] & ((1 << bits) - 1)], 1))
        n_rules += int(made.sum())
        at = queue[chosen]
        gone = right[at]
        after = right[gone]
        alive[gone] = False
        seq[at] = ids_of[pair[chosen]]
        right[at] = after
        left[after[after < n]] = at[after < n]
        # A place may come twice: as a frequent pair and beside a new symbol.
        queued[queue[~chosen]] = queued[at] = queued[left[at]] = True
        queue = np.flatnonzero(queued)
        queued[queue] = False
        queue = queue[alive[queue] & (right[queue] < n)]
    made = np.concatenate(rules)
    return made, _expansions(made, base), seq[:n][alive[:n]].astype(np.int64)


def _expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each rule stands for; rules of one level of nesting at a time."""
    lengths = np.zeros(len(rules), np.int64)
    waiting = np.arange(len(rules))
    while len(waiting):
        sides = rules[waiting]
        known = np.where(sides < base, 1, lengths[np.maximum(sides - base, 0)])
        ready = (known > 0).all(1)
        lengths[waiting[ready]] = known[ready].sum(1)
        waiting = waiting[~ready]
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for; each symbol of the derivation is visited once."""
    sizes = np.concatenate((np.ones(base, np.int32), lengths.astype(np.int32)))
    first, second = (np.ascontiguousarray(side, np.int32) for side in rules.T)
    own = sizes[seq]
    out = np.empty(int(own.sum()), np.int32)
    at = np.cumsum(own) - own
    while len(seq):
        inner = seq >= base
        out[at[~inner]] = seq[~inner]
        rule, at = seq[inner] - base, at[inner]
        left = first[rule]
        seq, at = np.concatenate((left, second[rule])), np.concatenate((at, at + sizes[left]))
    return out


class Shard:
    """One shard of the format.

    A header; the rules as pairs of ids; the rules' expansion lengths; the symbols; then for each
    document its id, whether it has one, and its number of tokens.  All numbers are little-endian.
    """

    def __init__(self, data: bytes):
        magic, version, _, self.base, n_rules, n_symbols, n_docs, self.n_tokens = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = take(n_rules, "<u4").astype(np.int64)
        self.symbols = take(n_symbols, "<u4").astype(np.int64)
        self.doc_ids = take(n_docs, "<i8")
        self.has_id = take(n_docs, "u1").astype(bool)
        self.sizes = take(n_docs, "<u8").astype(np.int64)
        own = np.ones(n_symbols, np.int64)
        inner = self.symbols >= self.base
        own[inner] = self.lengths[self.symbols[inner] - self.base]
        self.ends = np.cumsum(own)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from position ``start`` up to ``stop``; only symbols that overlap are expanded."""
        start, stop = max(0, start), min(stop, self.n_tokens)
        if start >= stop:
            return np.empty(0, np.int64)
        first = int(np.searchsorted(self.ends, start, side="right"))
        last = int(np.searchsorted(self.ends, stop, side="left"))
        offset = int(self.ends[first - 1]) if first else 0
        return expand(self.symbols[first : last + 1], self.rules, self.lengths, self.base)[start - offset : stop - offset]

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's document ``i``."""
        return self.tokens(int(self.starts[i]), int(self.starts[i] + self.sizes[i]))


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """A shard of the documents' ids."""
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    rules, lengths, symbols = compress(flat, base)
    head = _HEAD.pack(_MAGIC, 1, 0, base, len(rules), len(symbols), len(doc_ids), len(flat))
    parts = [
        rules.astype("<u4"), lengths.astype("<u4"), symbols.astype("<u4"),
        np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"),
        np.array([len(x) for x in ids], "<u8"),
    ]
    return head + b"".join(p.tobytes() for p in parts)


# --- encoding --------------------------------------------------------------------------------

_remembered: dict[str, _Pieces] = {}
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _pieces(text: str) -> list[str]:
    """The parts of a text between white space, in lower case.

    The tokenizer normalizes to NFC, lowers each character and drops white space, so the parts
    have the same ids as in the text.  Texts where that order matters stay as they are.
    """
    low = text.lower()
    if not text.isascii() and ("\u03a3" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
        low = text
    # Python takes four control characters for white space that the tokenizer does not.
    return re.split(r"[ \n\r\t]+", low) if any(x in low for x in _SEPARATORS) else low.split()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: a printable byte for
    itself, the others for the code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Pieces(dict):
    """The ids of pieces of text as bytes, found when first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(string.punctuation)
        if core and len(core) < len(piece) and core.isalpha():
            # A word with closing punctuation is the word and the punctuation, split by the tokenizer too.
            ids = self[core] + self[piece[len(core) :]]
        elif piece.isalpha() and piece.islower() and unicodedata.is_normalized("NFC", piece):
            # A word of lower-case letters is one match of the pattern, for the model alone.
            word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            ids = self.whole(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        """The ids of a text by the tokenizer."""
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


class _Encoder:
    """Encodes texts piece by piece; a worker remembers pieces' ids across tasks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _remembered:
            _remembered[path] = _Pieces(Tokenizer.from_file(path))
        self.known = _remembered[path]
        self.tokenizer = self.known.tokenizer
        # Special tokens are found in the text as it is written, so such a text is encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known, out = self.known, []
        for text in texts:
            if len(known) > MAX_REMEMBERED:
                known.clear()
            whole = any(x in text for x in self.special)
            raw = known.whole(text) if whole else b"".join(map(known.__getitem__, _pieces(text)))
            out.append(np.frombuffer(raw, np.uint32).astype(np.int64))
        return out


def _shards(path: str, end_id: int | None, shard_tokens: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = _Encoder(path)
        base = max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        end = np.array([] if end_id is None else [end_id], np.int64)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = before = 0

        def done():
            nonlocal doc_ids, ids, size, before, number
            blob = shard_bytes(doc_ids, ids, base)
            row = [[part], [number], [len(doc_ids)], [size], [before], [blob]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)
            doc_ids, ids, size, before, number = [], [], 0, before + size, number + 1
            return out

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["part", "shard", "n_docs", "n_tokens", "before", "data"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                coded = encoder([t or "" for t in batch.column(1).to_pylist()])
                for doc_id, own in zip(batch.column(0).to_pylist(), coded, strict=True):
                    own = np.concatenate([own, end])
                    if ids and size + len(own) > shard_tokens:
                        yield done()
                    doc_ids.append(doc_id)
                    ids.append(own)
                    size += len(own)
        if ids:
            yield done()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str | None = None,
    end_id: int | None = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the texts' token ids as shards in ascending order of their document ids.

    Texts are dealt out by ranges of id, sorted within each, encoded with the tokenizers library
    without special tokens, and ended by ``end_id`` (None: no end).  Each shard is a row of a
    Parquet table: (part, shard) give its place, ``before``
    the tokens before it in its part, and ``data`` its bytes as ``Shard`` reads them.
    Spark's writer commits whole tasks, so lost executors and repeated tasks leave no stray shards.

    Null and empty texts have the end id alone, null ids come first, rows of the same id are
    ordered by a hash of their text, other columns are left out, and no documents give no shards.
    A document is never cut, so one longer than ``shard_tokens`` is a shard of its own.
    """
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "row", "tie").sortWithinPartitions("row", "tie")
    shards = dealt.select("row", "text").mapInArrow(
        _shards(tokenizer_path, end_id, shard_tokens), "part int, shard int, n_docs bigint, n_tokens bigint, before bigint, data binary"
    )
    shards.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written shards with ``start``, the number of tokens before each.

    Each shard has the number of tokens before it in its part; those before a part are summed up
    in a table of one row for each part, of which there are as many as partitions.
    """
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(all_before), F.lit(0)).alias("offset"))
    return shards.join(stored(offsets, "offsets"), "part").withColumn("start", F.col("offset") + F.col("before"))


def _documents(with_ids: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                at = np.append(shard.starts, shard.n_tokens)
                flat = shard.tokens(0, shard.n_tokens).astype(np.int32)
                for i in range(0, len(shard.sizes), 500):
                    own = at[i : i + 501]
                    rows = pa.array([int(x) if ok else None for x, ok in zip(shard.doc_ids[i : i + 500], shard.has_id[i : i + 500], strict=True)], pa.int64())
                    values_le = flat[own[0] : own[-1]].astype("<u4").tobytes()
                    raw = [values_le[4 * a : 4 * b] for a, b in zip(own[:-1] - own[0], own[1:] - own[0], strict=True)]
                    columns = [rows, pa.array(own[:-1] + start), pa.array(np.diff(own)), pa.array(raw, pa.binary())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(flat[own[0] : own[-1]])))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_le", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le binary: little-endian 32-bit, ids array<int> if asked for) of all documents written."""
    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_le binary" + (", ids array<int>" if with_ids else "")
    return read_shards(spark, path).select("start", "data").mapInArrow(_documents(with_ids), kinds)


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, size and checksum, read back from written shards."""
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
