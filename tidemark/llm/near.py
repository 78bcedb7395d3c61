"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, sorted_groups, stored, table, whole_groups
from tidemark.llm.mixing import hidden_prefix

WORDS = 5
MIN_SIMILARITY = 0.8
#: Sketches of a text, and the k-mers that each keeps in text order.
SKETCHES, KEPT = 16, 2
#: Least k-mers of a text that are keys too, and their words.  A text of n words with n/5 of them
#: edited keeps 2n/5 three-word k-mers or more wherever the edits are, a Jaccard similarity of 0.25
#: at least, so that (1 - 0.25) ** 24 = 0.1 % of such pairs share no key; up to 26 words all are keys.
ANCHORS, ANCHOR_WORDS = 24, 3
#: Bins of the signature that tells which texts in a bucket are worth aligning.  The share of equal
#: bins estimates the Jaccard similarity of the words, counted with repeats.  Texts that align have
#: a least one, and it may be missed by so many standard errors of the estimate.
BINS, ERRORS = 128, 4.0
#: Texts of a bucket on each side of a comparison, and so many times as many where signatures alone are compared.
TILE, WIDER = 1024, 4
#: Buckets of up to so many texts are compared many at a time, and pairs whose signatures are held at once.
SMALL, CHUNK = 64, 50_000
#: Texts that are sketched at once.
TEXTS = 200


_SHIFTS, _FACTORS = np.array([30, 27, 31], np.uint64), np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    y = x >> _SHIFTS[0]
    y ^= x
    y *= _FACTORS[0]
    z = y >> _SHIFTS[1]
    y ^= z
    y *= _FACTORS[1]
    np.right_shift(y, _SHIFTS[2], out=z)
    y ^= z
    return y


_SEEDS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _mixed(np.arange(300, 364, dtype=np.uint64)) | np.uint64(1)


def _labelled(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """K-mers of hashed words, and the same labelled with their occurrence number.

    A text shorter than k words is one k-mer.
    """
    k = min(k, len(words))
    count = len(words) - k + 1
    grams = np.zeros(count, np.uint64)
    for j in range(k):
        grams += words[j : j + count] * _ODD[j]
    grams = _mixed(grams)
    ordered = np.sort(grams)
    if (ordered[1:] != ordered[:-1]).all():
        return grams, _mixed(grams)
    order = np.argsort(grams, kind="stable")
    same = np.concatenate(([False], grams[order][1:] == grams[order][:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(count)))
    number = np.empty(count, np.uint64)
    number[order] = (np.arange(count) - first).astype(np.uint64)
    return grams, _mixed(grams + number * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(words: np.ndarray, k: int, sketches: int, kept: int) -> np.ndarray:
    """Order MinHash sketches of hashed words.

    Each sketch takes the ``kept`` labelled k-mers of least hash and hashes them in the order in
    which they stand in the text.
    """
    grams, labelled = _labelled(words, k)
    count = len(grams)
    kept = min(kept, count)
    places = np.empty((sketches, kept), np.int64)
    step = max(1, 1_000_000 // count)  # sketches at once, so that a very long text takes bounded memory
    for t in range(0, sketches, step):
        u = min(t + step, sketches)
        h = (labelled ^ _SEEDS[t:u, None]) * _ODD[8 + t : 8 + u, None]
        h ^= h >> np.uint64(32)
        for r in range(kept):
            places[t:u, r] = least = h.argmin(1)
            h[np.arange(u - t), least] = np.iinfo(np.uint64).max
    places.sort(axis=1)
    chosen = grams[places]
    out = np.arange(sketches, dtype=np.uint64)
    for column in chosen.T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def least_kmers(words: np.ndarray, k: int, kept: int) -> np.ndarray:
    """The ``kept`` labelled k-mers of least hash, or all of a text that has no more.

    A text of 2k - 1 words, which one other word in its middle leaves without a k-mer, has a key of
    the rest too.
    """
    h = _mixed(_labelled(words, k)[1] ^ _SEEDS[254])
    out = np.partition(h, kept - 1)[:kept] if kept < len(h) else h
    if len(words) == 2 * k - 1:
        out = np.append(out, _labelled(np.delete(words, k - 1), len(words))[1] ^ _SEEDS[253])
    return out


def word_signature(words: np.ndarray, bins: int) -> np.ndarray:
    """A signature of ``bins`` bytes (0: empty bin) of hashed words labelled with their occurrence number."""
    place = _mixed(_labelled(words, 1)[1] ^ _SEEDS[255])
    signature = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(signature, (place % np.uint64(bins)).astype(np.int64), place >> np.uint64(8))
    filled = signature != np.iinfo(np.uint64).max
    return np.where(filled, 1 + signature % np.uint64(255), 0).astype(np.uint8)


def edit_distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if it is at most ``most``, else most + 1.

    Banded alignment: only cells within ``most`` of the diagonal are computed, a column of the
    band at a time, as the bits of integers that hold the differences of neighbouring cells.
    """
    if len(a) < len(b):
        a, b = b, a
    lead = 0
    while lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(b) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    longer = len(a) - len(b)
    if longer > most:
        return most + 1
    if not b:
        return longer
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, top, middle = (1 << 2 * most + 1) - 1, 1 << 2 * most, 1 << most
    up, down = mask & ~((1 << most + 1) - 1), 0  # where a cell exceeds, and is below, the one above it
    score = 0
    for j, x in enumerate(b):
        up, down = up >> 1 | top, down >> 1
        shift = j - most
        equal = places.get(x, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & mask
        right = down | (mask & ~(diagonal | up))
        left = diagonal & up
        if not diagonal & middle:
            score += 1
            if score - longer > most:
                return most + 1
        right = (right << 1 | 1) & mask
        up = (left << 1 & mask) | (mask & ~(diagonal | right))
        down = diagonal & right
    ends = ((1 << longer) - 1) << most + 1
    distance = score + (up & ends).bit_count() - (down & ends).bit_count()
    return min(distance, most + 1)


def similar(a: list, b: list, least: float) -> bool:
    """Whether the words of two texts align: 1 - edits / words of the longer is ``least`` or more.

    Words that no edit touches stand in both texts, so texts with too few words in common, counted
    with repeats, need no alignment.
    """
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - (Counter(a) & Counter(b)).total() > most:
        return False
    return edit_distance(a, b, most) <= most


def _coded(texts) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Texts' words as numbers, their words labelled with occurrences as numbers, and how many of these there are."""
    words: dict[bytes, int] = {}
    places: dict[tuple[int, int], int] = {}
    plain, labelled = [], []
    for text in texts:
        own = [words.setdefault(w, len(words)) for w in text.encode().split()]
        times: dict[int, int] = {}
        marks = np.empty(len(own), np.int32)
        for i, w in enumerate(own):
            times[w] = n = times.get(w, 0) + 1
            marks[i] = places.setdefault((w, n), len(places))
        plain.append(np.array(own, np.int32))
        labelled.append(marks)
    return plain, labelled, len(places)


def _sketched(k: int, sketches: int, kept: int, anchors: int, anchor_words: int, bins: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                h1, h2, n, keys, signatures = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = text.encode().split()
                    both = xxhash.xxh3_128_intdigest(b" ".join(words))
                    h1.append((both >> 64) - 2**63)
                    h2.append((both & (2**64 - 1)) - 2**63)
                    n.append(len(words))
                    if not words:
                        keys.append([])
                        signatures.append(b"")
                        continue
                    coded = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    # Sketches are even and least k-mers odd.
                    own = np.concatenate([order_sketches(coded, k, sketches, kept) & ~np.uint64(1), least_kmers(coded, anchor_words, anchors) | np.uint64(1)])
                    keys.append(np.unique(own.view(np.int64)))
                    signatures.append(word_signature(coded, bins).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    names=["id", "h1", "h2", "n", "keys", "signature"],
                )

    return run


def _agree(n: np.ndarray, signatures: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the texts of rows ``a`` and ``b`` are of about the same length and agree in enough bins.

    Words that no edit touches are common to two texts, so ``most`` edits leave them a least Jaccard
    similarity of their words wherever the edits are.
    """
    longer, shorter = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    out = longer - shorter <= most
    share = np.minimum((longer - most) / (shorter + most), 1.0)
    wanted = share - ERRORS * np.sqrt(share * (1 - share) / signatures.shape[1])
    near = np.flatnonzero(out)
    for at in range(0, len(near), CHUNK):
        rows = near[at : at + CHUNK]
        x, y = signatures[a[rows]], signatures[b[rows]]
        equal = np.count_nonzero((x == y) & (x != 0), axis=1)
        out[rows] = equal >= wanted[rows] * np.count_nonzero(x | y, axis=1)
    return out


def _agreeing(group, i: int, among: np.ndarray, least: float) -> np.ndarray:
    """Those of the rows ``among`` of a group that agree with its row i and have another id."""
    among = among[group["id"][among] != group["id"][i]]
    return among[_agree(group["n"], group["signature"], np.full(len(among), i), among, least)]


def _arrays(table, columns) -> dict[str, np.ndarray]:
    """Columns of a table as arrays, and its signatures as a matrix."""
    rows = {c: table.column(c).to_numpy() for c in columns}
    rows["signature"] = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return rows


def _small_pairs(starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows within the ``chosen`` groups, in parts of bounded size; the first row of a pair comes first in its group."""
    for size in np.unique(sizes[chosen]):
        first, second = np.triu_indices(size, 1)
        groups = starts[chosen & (sizes == size)]
        step = max(1, 4 * CHUNK // len(first))
        for at in range(0, len(groups), step):
            part = groups[at : at + step, None]
            yield (part + first).ravel(), (part + second).ravel()


def _stars(least: float):
    """Pairs of a tile that are worth aligning, at most one for each text.

    The texts that agree with the least of them form a star, then those left; in a small tile each
    text is paired with the least that it agrees with.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for table, starts in whole_groups(batches, 3):
            rows = _arrays(table, ("id", "n"))
            ids, sizes = rows["id"], np.diff(np.append(starts, table.num_rows))
            small = (sizes > 1) & (sizes <= SMALL)
            a_out, b_out = [], []
            for a, b in _small_pairs(starts, sizes, small):
                ok = (ids[a] != ids[b]) & _agree(rows["n"], rows["signature"], a, b, least)
                a, b = a[ok], b[ok]
                b, at = np.unique(b, return_index=True)
                a_out.append(ids[a[at]])
                b_out.append(ids[b])
            for start, size in zip(starts[~small], sizes[~small], strict=True):
                group = {c: v[start : start + size] for c, v in rows.items()}
                a, b, left = [], [], np.ones(size, bool)
                for i in range(size):
                    if left[i]:
                        left[i] = False
                        own = _agreeing(group, i, np.flatnonzero(left), least)
                        left[own] = False
                        a += [i] * len(own)
                        b += own.tolist()
                a_out.append(group["id"][a] if a else np.empty(0, np.int64))
                b_out.append(group["id"][b] if b else np.empty(0, np.int64))
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_out, b_out))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return run


def _sides(group, columns) -> tuple[dict, np.ndarray, np.ndarray]:
    """The rows of a tile, and which of them are queries and targets."""
    rows = _arrays(group, columns)
    return rows, np.flatnonzero(group.column("query").to_numpy()), np.flatnonzero(group.column("target").to_numpy())


def _apart(least: float, tile: int):
    """The texts of a tile that agree with one of another component.

    A tile of more than ``tile`` texts is parted here: in order of length into blocks, of which each pair
    whose texts agree is a tile of its own, with only the texts that do.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for table, starts in whole_groups(batches, 3):
            component = table.column("component").to_numpy()
            sizes = np.diff(np.append(starts, len(component)))
            mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            if not mixed.any():
                continue
            rows = _arrays(table, ("id", "n", "query", "target", "alone"))
            one = np.logical_and.reduceat(rows["query"] & rows["target"], starts)
            small = mixed & one & (sizes <= SMALL)
            met = np.zeros(len(component), bool)
            for a, b in _small_pairs(starts, sizes, small):
                other = (component[a] != component[b]) & (rows["id"][a] != rows["id"][b])
                a, b = a[other], b[other]
                ok = _agree(rows["n"], rows["signature"], a, b, least)
                met[a[ok]] = met[b[ok]] = True
            parted = []
            for start, size in zip(starts[mixed & ~small], sizes[mixed & ~small], strict=True):
                group = {c: v[start : start + size] for c, v in rows.items()} | {"component": component[start : start + size]}
                block = np.zeros(size, np.int64)
                block[np.argsort(group["n"], kind="stable")] = np.arange(size) // tile
                asks, asked = _meetings(group, block, least)
                if size <= tile:
                    met[start : start + size] = asks[0] | asked[0]
                else:
                    parted += _parted(start, block, asks, asked)
            columns = table.select(["key", "i", "j", "id", "query", "target", "alone"])
            if met.any():
                yield from columns.take(pa.array(np.flatnonzero(met))).to_batches()
            for places, number, query, target in parted:
                out = columns.take(pa.array(places))
                j = pa.array((out.column("j").to_numpy().astype(np.int64) << 12 | number).astype(np.int32))
                parts = [out.column(0), out.column(1), j, out.column(3), pa.array(query), pa.array(target), out.column(6)]
                yield from pa.table(parts, schema=columns.schema).to_batches()

    return run


def _meetings(group, block: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """By block and row of a tile: whether the row agrees, as a query, with a target of the block, and as a target with a query of it.

    Of two texts that meet both ways the one of lesser id is the query.
    """
    ids, n, component, alone = group["id"], group["n"], group["component"], group["alone"]
    asks, asked = (np.zeros((block.max() + 1, len(ids)), bool) for _ in range(2))
    queries, targets = np.flatnonzero(group["query"]), np.flatnonzero(group["target"])
    targets = targets[np.argsort(n[targets], kind="stable")]
    # Slightly wider than what _agree takes.
    firsts = np.searchsorted(n[targets], n[queries] * least - 2)
    lasts = np.searchsorted(n[targets], n[queries] / max(least, 0.01) + 2, "right")
    for i, first, last in zip(queries.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        among = targets[first:last]
        among = among[(component[among] != component[i]) & (alone[i] | alone[among] | (ids[among] > ids[i]))]
        own = _agreeing(group, i, among, least)
        asks[block[own], i] = True
        asked[block[i], own] = True
    return asks, asked


def _parted(start: int, block: np.ndarray, asks: np.ndarray, asked: np.ndarray) -> Iterator[tuple]:
    """The tiles of pairs of blocks: rows, the tile's number, and which rows are queries and targets."""
    for q in range(len(asks)):
        for t in range(len(asks)):
            query, target = asks[t] & (block == q), asked[q] & (block == t)
            if query.any():
                places = np.flatnonzero(query | target)
                yield start + places, q << 6 | t, query[places], target[places]


def _links_apart(least: float):
    """Aligns the pairs of a tile that agree and are of different components, and returns links alone.

    A pair is aligned in one of the buckets that its texts share, dealt by their ids so that a group
    in many buckets is spread over them, unless links found here have joined it meanwhile.  Pairs
    with too few words in common to align are told from counts of their words.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for group in sorted_groups(batches, 3):
            rows, queries, targets = _sides(group, ("id", "n", "component", "key", "alone"))
            if not len(queries) or not len(targets):
                continue
            ids, n, component, alone = rows["id"], rows["n"], rows["component"], rows["alone"]
            held = group.column("keys").to_pylist()
            none = np.iinfo(np.int64).min
            keys = np.full((len(held), max(map(len, held))), none)
            for row, own in zip(keys, held, strict=True):
                row[: len(own)] = own
            plain, labelled, n_labels = _coded(x.as_py() for x in group.column("text"))
            marked = np.zeros(n_labels, bool)
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            a_out, b_out = [], []
            for a in queries.tolist():
                others = _agreeing(rows, a, targets[(component[targets] != component[a]) & (alone[a] | alone[targets] | (ids[targets] > ids[a]))], least)
                if not len(others):
                    continue
                theirs = keys[others]
                shared = np.isin(theirs, keys[a]) & (theirs != none)
                count = np.maximum(shared.sum(1), 1)
                turn = (ids[a] % count + ids[others] % count) % count  # the same whichever of the two is the query
                dealt = shared & (shared.cumsum(1) == turn[:, None] + 1) & (theirs == rows["key"][a])
                others = others[dealt.any(1)]
                if not len(others):
                    continue
                marked[labelled[a]] = True
                common = np.array([marked[labelled[r]].sum() for r in others])
                marked[labelled[a]] = False
                longer = np.maximum(n[a], n[others])
                most = ((1 - least) * longer + 1e-9).astype(np.int64)
                own = plain[a].tolist()
                for b, edits in zip(others[longer - common <= most], most[longer - common <= most], strict=True):
                    ca, cb = root(int(component[a])), root(int(component[b]))
                    if ca != cb and edit_distance(own, plain[int(b)].tolist(), int(edits)) <= edits:
                        parent[max(ca, cb)] = min(ca, cb)
                        a_out.append(int(ids[a]))
                        b_out.append(int(ids[b]))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _aligned(least: float):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                a, b = [], []
                for row in whole.slice(at, 200).to_pylist():
                    if similar(row["text_a"].encode().split(), row["text_b"].encode().split(), least):
                        a.append(row["a"])
                        b.append(row["b"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _star_tiles(buckets: DataFrame, tile: int) -> DataFrame:
    """Adds ``i`` and ``j`` (int): a bucket of more than ``tile`` texts is dealt into tiles, each text into one and the least text into all."""
    hot = buckets.groupBy("key").agg(F.count("*").alias("_n"), F.min("id").alias("_least")).where(F.col("_n") > tile)
    hot = stored(hot.select(F.col("key").alias("_hot"), "_least", F.ceil(F.col("_n") / tile).cast("int").alias("_k")), "hot")
    dealt = buckets.join(hot, F.col("key") == F.col("_hot"), "left")
    own = F.array(F.coalesce(F.pmod(F.xxhash64("id", "key"), F.col("_k")).cast("int"), F.lit(0)))
    tiles = F.when(F.col("id") == F.col("_least"), F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(own)
    return dealt.withColumn("i", F.explode(tiles)).select(*buckets.columns, "i", F.lit(0).alias("j"))


def _within_reach(rows: DataFrame, least: float) -> DataFrame:
    """The texts of buckets, with their components, that have one of another component and of about their length in a bucket.

    Of two texts that agree both are kept: quarters of bands of length tell them, so that only their least and greatest components are exchanged.
    """
    quarter = F.floor(F.ln("n") / F.lit(math.log(1.01 / max(least, 0.01)) / 4)).cast("int")
    rows = rows.withColumn("_own", quarter)
    around = Window.partitionBy("_key").orderBy("_part").rangeBetween(-4, 4)
    parts = rows.groupBy(F.col("key").alias("_key"), F.col("_own").alias("_part")).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    parts = parts.withColumns({"_lo": F.min("_lo").over(around), "_hi": F.max("_hi").over(around)}).where("_lo <> _hi")
    return rows.join(parts, (F.col("key") == F.col("_key")) & (F.col("_own") == F.col("_part")), "left_semi").drop("_own")


def _apart_tiles(rows: DataFrame, tile: int, least: float) -> DataFrame:
    """Deals buckets' texts, with their components, into tiles in which all pairs meet that may agree and are of different components.

    Adds ``i``, ``j`` (int), ``query``, ``target`` and ``alone`` (boolean).  Buckets of one component need
    no tile.  Others of up to ``tile`` texts are one tile.  In larger ones texts that
    agree are of about the same length, so targets are dealt by bands of length, in which a text and one that
    agrees with it are at most one apart; queries go to their own band and to the next.  If one component
    has most of a bucket its texts are targets alone, and the others are queries of the band before too.
    ``alone`` marks a row of a pair that does not meet the other way round as well.
    """
    yes, no = F.lit(True), F.lit(False)
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("_n")).groupBy(F.col("key").alias("_mixed"))
    mixed = sizes.agg(F.max(F.struct("_n", "component")).alias("_most"), F.sum("_n").alias("_all")).where("_most._n < _all")
    major = F.when(F.col("_most._n") * 2 > F.col("_all"), F.col("_most.component"))
    mixed = stored(mixed.select("_mixed", major.alias("_major"), (F.col("_all") > tile).alias("_large")), "mixed")
    cold = rows.join(mixed.where("not _large"), F.col("key") == F.col("_mixed"), "left_semi")
    cold = cold.withColumns({"i": F.lit(0), "j": F.lit(0), "query": yes, "target": yes, "alone": no})
    # Slightly wider than the greatest quotient of lengths, so that rounding parts no pair.
    band = F.floor(F.ln("n") / F.ln(F.lit(1.01 / max(least, 0.01)))).cast("int") + 1
    large = rows.withColumn("_own", band).join(mixed.where("_large"), F.col("key") == F.col("_mixed")).drop("_mixed", "_large")
    first = F.when(F.col("_major").isNull(), F.col("_own")).otherwise(F.col("_own") - 1)
    visits = large.where("not component <=> _major").withColumn("_band", F.explode(F.sequence(first, F.col("_own") + 1)))
    visits = stored(visits.withColumns({"_main": no, "_query": yes, "_target": F.col("_band") == F.col("_own")}), "visits")
    # Texts of the component that has most of a bucket are exchanged only where another text visits their band.
    visited = visits.select(F.col("key").alias("_key"), F.col("_band").alias("_b")).distinct()
    main = large.where("component = _major").join(visited, (F.col("key") == F.col("_key")) & (F.col("_own") == F.col("_b")), "left_semi")
    large = visits.unionByName(stored(main.withColumns({"_band": F.col("_own"), "_main": yes, "_query": no, "_target": yes}), "main"))
    sides = large.groupBy(F.col("key").alias("_key"), F.col("_band").alias("_b")).agg(F.count_if("_query").alias("_q"), F.count_if("_target").alias("_t"))
    parts = lambda c: F.ceil(F.col(c) / tile).cast("int")
    sides = sides.where("_q > 0 and _t > 0").select("_key", "_b", parts("_q").alias("_kq"), parts("_t").alias("_kt"))
    large = large.join(sides, (F.col("key") == F.col("_key")) & (F.col("_band") == F.col("_b")))
    row, column = F.pmod(F.xxhash64("id"), F.col("_kq")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("_kt")).cast("int")

    def place(i: Column, j: Column, query: Column, target: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), query.alias("query"), target.alias("target"))

    across = F.transform(F.sequence(F.lit(0), F.col("_kt") - 1), lambda j: place(row, j, yes, F.col("_target") & (j == column)))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.col("_kq") - 1), lambda i: F.col("_target") & (~F.col("_query") | (i != row))), lambda i: place(i, column, no, yes))
    large = large.withColumn("_place", F.explode(F.when(F.col("_query"), F.concat(across, down)).otherwise(down)))
    # The band is part of the tile's number.
    i, alone = F.shiftleft(F.col("_band"), 20) + F.col("_place.i"), F.col("_main") | (F.col("_band") != F.col("_own"))
    large = large.select(*rows.columns, i.alias("i"), "_place.j", "_place.query", "_place.target", alone.alias("alone"))
    return cold.unionByName(large)


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    min_similarity: float = MIN_SIMILARITY,
    sketches: int = SKETCHES,
    kept: int = KEPT,
    bins: int = BINS,
    tile: int = TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    anchors: int = ANCHORS,
    anchor_words: int = ANCHOR_WORDS,
) -> DataFrame:
    """Groups documents whose words align to ``min_similarity`` or more, chained.

    Similarity is 1 - edit distance / words of the longer text, over words.  Candidates share an
    Order MinHash sketch of ``words``-word k-mers or one of the ``anchors`` least k-mers of
    ``anchor_words`` words, agree in enough bins of a signature of their words, and are of about
    the same length; banded alignment decides.

    1. Texts of the same words are one text, with the least id.
    2. Within each bucket of a sketch the texts that agree with the least of them are paired with it,
       at most one pair a text.  Pairs of all buckets are verified, and linked texts form components.
    3. The pairs of a bucket of any key that agree and are still apart are all aligned where the bucket's
       texts are, so that no link within a bucket is lost; only links leave the task, and copies
       are never expanded into all pairs.

    Buckets of more than ``tile`` texts are dealt into tiles: for stars each text into one, for what is
    still apart, where signatures alone are compared, those of more than ``WIDER`` times as many by bands of
    length and only where components differ.  Only texts of candidates are exchanged and kept.  Returns (id_col, component_id bigint: the least id of the
    group, kept boolean: whether it is that id), a row for each input row.  Null texts and ids
    link with nothing (a null id has a null component and is kept); texts without words are
    copies of one another; rows that share an id are one document of all their texts.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    usable = rows.where("id is not null and text is not null")
    sketched = stored(
        usable.mapInArrow(_sketched(words, sketches, kept, anchors, anchor_words, bins), "id bigint, h1 bigint, h2 bigint, n int, keys array<bigint>, signature binary"), "sketches"
    )
    least = sketched.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    firsts = sketched.join(least, ["h1", "h2"]).where("id = rep").dropDuplicates(["id", "h1", "h2"])
    firsts = stored(firsts.select("id", "n", "keys", "signature"), "texts")
    keyed = firsts.select("id", F.explode("keys").alias("key"))
    # Keys that the same texts share, as many keys of close copies are, make one bucket.
    mark = F.xxhash64("id")
    shared = keyed.groupBy("key").agg(F.count("*").alias("times"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit(2**31 - 1))).alias("y"))
    even_first = F.struct(F.col("key").bitwiseAND(1).alias("odd"), "key")
    shared = shared.where("times > 1").groupBy("times", "x", "y").agg(F.min(even_first).alias("one")).select("one.key")
    members = keyed.join(shared, "key")
    # Signatures are most of a row, so they join a bucket's texts only where these are dealt into tiles.
    buckets = stored(members.join(firsts.select("id", "n").distinct(), "id").select("key", "id", "n"), "buckets")
    signed = firsts.select("id", "n", "signature")

    def in_tiles(rows: DataFrame, columns: list[str]) -> DataFrame:
        out = rows.select("key", "i", "j", *columns)
        return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    tiles = _star_tiles(buckets.where(F.col("key").bitwiseAND(1) == 0), tile).join(signed, ["id", "n"])
    found = in_tiles(tiles, ["id", "n", "signature"]).mapInArrow(_stars(min_similarity), "a bigint, b bigint")
    stars = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids = stored(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = stored(usable.join(ids, F.col("id") == F.col("node"), "left_semi"), "candidates")
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    links = stored(stars.join(a, "a").join(b, "b").mapInArrow(_aligned(min_similarity), "a bigint, b bigint"), "links")

    components = stored(connected_components(links), "components")
    labelled = buckets.join(components, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    sides = ["query", "target", "alone"]
    tiles = _apart_tiles(stored(_within_reach(labelled, min_similarity), "reach"), WIDER * tile, min_similarity).join(signed, ["id", "n"])
    apart = in_tiles(tiles, ["id", "n", "signature", "component", *sides]).mapInArrow(
        _apart(min_similarity, tile), "key bigint, i int, j int, id bigint, query boolean, target boolean, alone boolean"
    )
    apart = stored(apart, "apart")
    # A text may agree with members of stars alone, so that it is in no star itself.
    ids = stored(apart.select(F.col("id").alias("node")).distinct(), "nodes")
    texts = stored(usable.join(ids, F.col("id") == F.col("node"), "left_semi"), "candidates")
    held = buckets.join(ids, F.col("id") == F.col("node"), "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    known = stored(firsts.drop("keys").join(held, "id"), "apart_texts")
    known = known.join(components, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    more = apart.join(known, "id").join(texts, "id")
    more = in_tiles(more, ["id", "n", "signature", "component", "keys", "text", *sides]).mapInArrow(_links_apart(min_similarity), "a bigint, b bigint")
    links = links.unionByName(stored(more, "links"))
    components = connected_components(links)
    classes = sketched.select("id", "h1", "h2").join(least, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = classes.join(components, F.col("b") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    classes = stored(classes.groupBy("node").agg(F.min("component").alias("component")), "classes")
    out = rows.select("id").join(classes, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without those that another of their group stands for.

    The document of least id stays of each group, one row of it; rows with a null id or text stay.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **how)
    p = hidden_prefix(docs)
    gone = stored(found.where("not kept").select(F.col(id_col).alias(f"{p}gone")).distinct(), "gone")
    left = docs.join(gone, F.col(id_col) == F.col(f"{p}gone"), "left_anti")
    alike = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(f"{p}twice")).agg(F.count("*").alias(f"{p}n")).where(F.col(f"{p}n") > 1)
    alike = stored(alike.select(f"{p}twice"), "twice")
    once = left.join(alike, F.col(id_col) == F.col(f"{p}twice"), "left_anti")
    first = left.join(alike, F.col(id_col) == F.col(f"{p}twice"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(first)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate group, and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))
