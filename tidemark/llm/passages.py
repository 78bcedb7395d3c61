"""Substring dedup: repeated passages, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, table

WINDOW = 35
#: Words of a phrase that anchors windows: of the phrases in a window the one of least hash.
PHRASE = 8
#: An anchor that occurs more often is dealt into several automata.
HOT = 4096
#: Automata for each shuffle partition.
SHARDS = 4
#: Bytes of text whose words a task hashes together; a longer text is taken alone.
TOGETHER = 1 << 20


_ODD = np.random.default_rng(5).integers(1, 2**63, size=4096, dtype=np.uint64) | np.uint64(1)
_BYTES = np.random.default_rng(6).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those for usual sizes are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, 2 * TOGETHER)
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    if size == 2 * TOGETHER:
        _powers[:] = both
    return both[0][:n], both[1][:n]


def _polynomials(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, mixer: int) -> np.ndarray:
    """A 64-bit hash of each range of values: a polynomial in an odd base, whose powers can be undone."""
    powers, back = _powers_of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    out = (sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64) * _ODD[0]
    out ^= out >> np.uint64(31)
    out *= np.uint64(mixer)
    return out ^ (out >> np.uint64(30))


def _runs_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += words[j : j + count] * _ODD[j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The words of texts one after another: (hash of each word, bounds, bytes, begins, ends).

    Text i has the words from ``bounds[i]`` to ``bounds[i + 1]``, and word j is the bytes from
    ``begins[j]`` to ``ends[j]``.  Words are found and hashed without an object for each.
    """
    raw = b" ".join([*texts, b""])
    coded = np.frombuffer(raw, np.uint8)
    space = _SPACE[coded]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(coded) and not space[0]:
        turns = np.concatenate(([0], turns))
    # The last byte is a space, so turns into words and out of words alternate.
    begins, ends = turns[::2], turns[1::2]
    bounds = np.searchsorted(begins, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))))
    return _polynomials(_BYTES[coded], begins, ends, 0xFF51AFD7ED558CCD), bounds, raw, begins, ends


def anchored(words: np.ndarray, bounds: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with the same anchor: (first window, number of windows, anchor, weight).

    ``words`` holds texts one after another, text i from ``bounds[i]`` to ``bounds[i + 1]``; windows
    do not cross texts, and first windows are places in ``words``.
    A window's anchor depends on its words alone, so equal windows have equal anchors.  Weight is
    2 where the anchor's phrase occurs again in the same text, so that repeats within a run count.
    """
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none, np.empty(0, np.uint64), none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    phrases = _runs_hash(words, phrase)
    anchors = _sliding_min(phrases, window - phrase + 1)
    inside = text[: len(anchors)] == text[window - 1 :]
    changed = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (text[1 : len(anchors)] != text[: len(anchors) - 1])))
    starts = np.flatnonzero(inside & changed)
    # A run ends before the next place that starts a run or lies in no window.
    stops = np.append(np.flatnonzero(changed | ~inside), len(anchors))
    sizes = stops[np.searchsorted(stops, starts, side="right")] - starts
    own = anchors[starts]
    # Phrases of one text that are equal are equal after the text's number is mixed in.
    mixed = (text.astype(np.uint64) + np.uint64(1)) * _ODD[1]
    whole = text[: len(phrases)] == text[phrase - 1 :]
    ordered = np.sort((phrases + mixed[: len(phrases)])[whole])
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    weight = np.ones(len(own), np.int64) if not len(again) else 1 + np.isin(own + mixed[starts], again)
    return starts, sizes, own, weight


def _slices(whole, column: int) -> Iterator:
    """A batch in slices of about ``TOGETHER`` bytes of a text column."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < whole.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield whole.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def _anchors(window: int, phrase: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in _slices(whole, 2):
                words, bounds, *_ = _together([(t or "").encode() for t in batch.column(2).to_pylist()])
                starts, _, anchors, weights = anchored(words, bounds, window, phrase)
                row = np.searchsorted(bounds, starts, side="right") - 1
                starts, rows = starts - bounds[row], pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts.astype(np.int32)), pa.array(anchors.view(np.int64)), pa.array(weights.astype(np.int32))],
                    names=["k1", "k2", "start", "anchor", "weight"],
                )

    return run




def _segments(window: int, phrase: int, with_text: bool):
    """For each run of windows whose anchor recurs its place and, if asked for, its words."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["k1", "k2", "start", "anchor", "parts", "segment", "words"]
        for whole in batches:
            for batch in _slices(whole, 2):
                found = batch.column(3)
                lengths = np.asarray(found.value_lengths())
                flat = found.flatten()
                places, parts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                row = np.repeat(np.arange(batch.num_rows), lengths)
                rows = pa.array(row)
                words, bounds, raw, word_begins, word_ends = _together([text.encode() for text in batch.column(2).to_pylist()])
                starts, sizes, all_anchors, _ = anchored(words, bounds, window, phrase)
                own = places.astype(np.int64) + bounds[row]
                i = np.searchsorted(starts, own)
                ends = own + sizes[i] + window - 1
                anchors, segments = all_anchors[i], _polynomials(words, own, ends, 0x94D049BB133111EB)
                spoken = []
                if with_text:
                    spoken = [b" ".join(raw[a:b].split()) for a, b in zip(word_begins[own].tolist(), word_ends[ends - 1].tolist(), strict=True)]
                columns = [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places.astype(np.int32)), pa.array(anchors.view(np.int64)),
                    pa.array(parts.astype(np.int32)), pa.array(segments.view(np.int64)),
                    pa.array(spoken, pa.binary()) if with_text else pa.nulls(len(places), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _window_hashes(texts: list[bytes], window: int) -> Iterator[list[int]]:
    """The hashes of all windows of each text, computed over many texts at once."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
            size += len(texts[stop])
            stop += 1
        words, bounds, *_ = _together(texts[at:stop])
        runs = _runs_hash(words, window).view(np.int64) if len(words) >= window else np.empty(0, np.int64)
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield runs[begin : max(begin, end - window + 1)].tolist()
        at = stop


def _windows(window: int):
    """The windows of segments, as (anchor, hash, times)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            anchors, found, times = [], [], []
            rows = batch.to_pylist()
            for row, own in zip(rows, _window_hashes([row["words"] for row in rows], window), strict=True):
                found += own
                anchors += [row["anchor"]] * len(own)
                times += [row["times"]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["anchor", "window", "times"])

    return run


def _located(window: int):
    """Compiles the confirmed passages of a shard into an automaton and streams its segments.

    Passages are runs of windows that recur, as sequences of word numbers.  ``confirmed`` holds
    windows counted beforehand, of anchors that are dealt into several shards; those of other
    anchors, whose segments are all here, are counted here.
    """

    def run(segments, confirmed):
        import ahocorasick
        import pyarrow as pa

        known = set(zip(confirmed["anchor"].to_pylist(), confirmed["window"].to_pylist(), strict=True))
        rows = segments.select(["anchor", "segment", "times", "parts", "words"]).to_pylist()
        counts: dict[tuple[int, int], int] = {}
        windows = []
        for row, found in zip(rows, _window_hashes([row["words"] for row in rows], window), strict=True):
            own = [(row["anchor"], h) for h in found]
            windows.append(own)
            if row["parts"] == 1:
                for w in own:
                    counts[w] = counts.get(w, 0) + row["times"]
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        texts = []
        for row, own in zip(rows, windows, strict=True):
            coded = tuple(numbers.setdefault(w, len(numbers)) for w in row["words"].split(b" "))
            texts.append(coded)
            start = None
            for i, w in enumerate([*own, None]):
                recurs = w is not None and (w in known if row["parts"] > 1 else counts[w] > 1)
                if recurs and start is None:
                    start = i
                elif not recurs and start is not None:
                    automaton.add_word(coded[start : i + window - 1], i + window - 1 - start)
                    start = None
        out: dict[str, list] = {"anchor": [], "segment": [], "spans": []}
        if len(automaton):
            automaton.make_automaton()
            for row, coded in zip(rows, texts, strict=True):
                spans: list[int] = []  # begin, end, begin, end, ...
                for end, size in automaton.iter(coded):
                    begin = end + 1 - size
                    while spans and begin <= spans[-1]:
                        begin = min(begin, spans[-2])
                        del spans[-2:]
                    spans += [begin, end + 1]
                if spans:
                    for k, v in (("anchor", row["anchor"]), ("segment", row["segment"]), ("spans", spans)):
                        out[k].append(v)
        return pa.table([pa.array(out["anchor"], pa.int64()), pa.array(out["segment"], pa.int64()), pa.array(out["spans"], pa.list_(pa.int32()))], names=list(out))

    return run


def _kept(batches) -> Iterator:
    """The words that no span covers."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            n_words, n_removed, kept, spans_out = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                spans: list[list[int]] = []
                if found:
                    for a, b in sorted((f["start"] + x, f["start"] + y) for f in found for x, y in zip(f["spans"][::2], f["spans"][1::2], strict=True)):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    at_word, left = 0, []
                    for a, b in spans:
                        left += words[at_word:a]
                        at_word = b
                    words = left + words[at_word:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
                spans_out.append([{"begin": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept), pa.array(spans_out, span)],
                names=["row", "n_words", "n_removed", "kept", "spans"],
            )


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by ``window`` words in sequence that also start anywhere else.

    Words are runs of characters other than ASCII white space.  Steps:

    1. Each window is anchored at the phrase in it of least hash; runs of windows share an
       anchor, about one for 14 words.  Anchors that occur once cannot be in a repeated window.
    2. Texts with recurring anchors give the segments of words around them; equal segments are
       one with a count.
    3. Segments are dealt into shards by anchor.  A shard confirms the windows that recur,
       compiles their passages into an Aho-Corasick automaton over words and streams its segments
       through it.  An anchor that occurs more than ``hot`` times has its windows counted by
       Spark beforehand, and its segments dealt over several shards.
    4. The located spans go back to all texts that hold the segment.

    Texts are exchanged once, by a hash of id and text; the rest of the exchanges are narrow or of
    the segments that recur.  Windows are compared by 128 bits of hash, segments are searched as
    words.  Returns (id_col, n_words, n_removed, kept string, spans array of (begin, end) words),
    a row for each input row.  Null texts have no words; null and repeated ids are kept; rows that
    are equal count as two texts, so all their windows recur; other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]
    rows = docs.select(*key, F.col(id_col).alias("row"), text.alias("text"))
    found = rows.select("k1", "k2", "text").mapInArrow(_anchors(window, phrase), "k1 bigint, k2 bigint, start int, anchor bigint, weight int")
    recurring = (
        found.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1")
        .select(F.col("anchor").alias("again"), F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    )
    candidates = (
        found.join(recurring, found["anchor"] == recurring["again"])
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "parts")).alias("found"))
    )
    dealt = rows.repartition(partitions(spark), "k1", "k2")
    # All columns stay, so that this exchange of the texts is the one that the last join uses too.
    chosen = dealt.join(candidates.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "found", "row")
    kinds = "k1 bigint, k2 bigint, start int, anchor bigint, parts int, segment bigint, words binary"
    segments = (
        chosen.mapInArrow(_segments(window, phrase, True), kinds)
        .groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.max("parts").alias("parts"), F.first("words").alias("words"))
    )
    places = chosen.mapInArrow(_segments(window, phrase, False), kinds).select("k1", "k2", "start", "anchor", "segment")
    shards = SHARDS * partitions(spark)
    several = segments.where("parts > 1").select("anchor", "times", "words").mapInArrow(_windows(window), "anchor bigint, window bigint, times bigint")
    confirmed = several.groupBy("anchor", "window").agg(F.sum("times").alias("times")).where("times > 1").select("anchor", "window")
    parts_of = recurring.where("parts > 1")
    confirmed = confirmed.join(parts_of, confirmed["anchor"] == parts_of["again"])
    shard = lambda part: F.pmod(F.xxhash64("anchor", part), F.lit(shards)).cast("int")
    confirmed = confirmed.select("anchor", "window", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    confirmed = confirmed.select("anchor", "window", shard(F.col("part")).alias("shard")).distinct()
    segments = segments.withColumn("shard", shard(F.pmod("segment", "parts").cast("int")))
    located = (
        segments.groupBy("shard").cogroup(confirmed.groupBy("shard"))
        .applyInArrow(_located(window), "anchor bigint, segment bigint, spans array<int>")
    )
    spans = places.join(located, ["anchor", "segment"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "spans")).alias("found"))
    out = dealt.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", "found")
    return out.mapInArrow(
        _kept, f"row {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string, spans array<struct<begin:int,end:int>>"
    ).withColumnRenamed("row", id_col)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 35-word windows that also start elsewhere."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
