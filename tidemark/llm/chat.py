"""Chat formatting as prefix trees: initial turns that conversations share are written once.

A turn is written as ``<s>[INST] role [/INST]text</s>``.  Control strings inside roles and texts are
broken by a backslash after their first character, and backslashes are doubled, so that no text can
end a turn and every text can be had back.  A turn's writing does not depend on other turns, so the
turns that conversations begin with in common are nodes of a tree.

Conversations are sorted by the hashes of their prefixes, which is the tree's depth-first order, and
cut into packs of bounded size.  A pack writes each of its nodes once; each has its offset in the
pack, the position of its first character in its conversations, and the intervals of the pack that
its ancestors take up, which are what its characters attend to besides the node itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import new_path, partitions, table

OPEN, NAMED, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: The character after which a control string is broken, seen before the rest of one.
CONTROL = r"([<\[])(?=/?s>|/?INST\])"
LEARNED = "assistant"
#: Characters of a pack, and what a conversation counts besides its new characters.
PACK, LEAF = 1 << 18, 64
_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
NODES = StructType([
    StructField("pack", LongType()), StructField("segment", IntegerType()), StructField("parent", IntegerType()), StructField("leaf", BooleanType()), StructField("conv_id", LongType()),
    StructField("text", StringType()), StructField("start", LongType()), StructField("position", LongType()), StructField("attends", ArrayType(_SPAN)), StructField("loss_start", LongType()), StructField("loss_stop", LongType()),
])
READ = StructType([
    StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
    StructField("formatted_chars", LongType()),
])


def escaped(x: Column) -> Column:
    """A text in which no control string stands, and from which ``plain`` gives the text back."""
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), CONTROL, r"$1\\")


def plain(text: str) -> str:
    """What ``escaped`` made ``text`` from."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parsed(segment: str) -> tuple[str, str]:
    """The role and text of one written turn."""
    end = segment.index(NAMED, len(OPEN))
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not one written turn")
    return plain(segment[len(OPEN) : end]), plain(segment[end + len(NAMED) : -len(CLOSE)])


def written_turns(conversations: DataFrame) -> DataFrame:
    """Each turn as written, with its number, its position in the conversation and the hash of all turns so far.

    The hash of a prefix is the exclusive or of hashes of (number, role, text): it runs along a
    conversation's rows in one window, which Spark spills where a conversation is long.
    """
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "said")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(NAMED))
    t = t.withColumn("seq", F.row_number().over(w)).withColumn("head", head).withColumn("body", escaped(F.col("said")))
    t = t.select(
        "conv_id", "turn", "role", "said", "seq", F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.char_length("head").alias("before"), F.char_length("body").alias("inside"),
        F.xxhash64("seq", "role", "said").alias("h1"), F.xxhash64(F.lit(7), "seq", "role", "said").alias("h2"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("text").cast("bigint")
    return t.select(
        "conv_id", "seq", "text", size.alias("size"), (F.sum(size).over(running) - size).alias("position"), F.bit_xor("h1").over(running).alias("p1"), F.bit_xor("h2").over(running).alias("p2"),
        *[F.when(F.col("role") == LEARNED, x.cast("bigint")).alias(n) for n, x in (("loss_from", F.col("before")), ("loss_to", F.col("before") + F.col("inside")))],
    )


def _packing(pack_chars: int):  # noqa: ANN202
    """Cuts sorted conversations into packs; tells how many first turns of each the pack holds already."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        pack, used, place, last = -1, 0, 0, ([], [])
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                p1, p2, size = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                shared = 0
                for a, b, c, d in zip(p1, last[0], p2, last[1], strict=False):
                    if a != b or c != d:
                        break
                    shared += 1
                cost = LEAF + sum(size[shared:])
                if pack < 0 or used + cost > pack_chars:
                    pack, used, place, shared = pack + 1, 0, 0, 0
                    cost = LEAF + sum(size)
                used += cost
                out.append((base + pack, place, shared, len(p1)))
                place, last = place + 1, (p1, p2)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(cols)]], names=["conv_id", "pack", "place", "shared", "n"])

    return run


def packs_of(turns: DataFrame, pack_chars: int) -> DataFrame:
    """(conv_id, pack, place, shared, n): where each conversation stands, and how many of its ``n`` turns stand there already.

    A conversation is here the hashes and sizes of its turns, not their text.  Conversations that
    share turns are neighbours in the order of prefix hashes, so a prefix of a third of all
    conversations is spread over as many ranges and packs as they need, and written once in each.
    """
    path = F.array_sort(F.collect_list(F.struct("seq", "p1", "p2", "size")))
    one = turns.groupBy("conv_id").agg(path.alias("path")).select("conv_id", *[F.col(f"path.{c}").alias(c) for c in ("p1", "p2", "size")])
    order = ["p1", "p2", F.asc_nulls_last("conv_id")]
    dealt = one.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_packing(pack_chars), "conv_id bigint, pack bigint, place int, shared int, n int")


def _building(batches: Iterator) -> Iterator:
    """Nodes and leaves of packs, from rows sorted by pack, place and turn; holds one path at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODES)
    at = None  # the pack
    for batch in batches:
        out = []
        rows = zip(*[batch.column(c) for c in range(batch.num_columns)], strict=True)
        for row in rows:
            pack, place, seq, shared, conv, text, position, loss_from, loss_to = (x.as_py() for x in row)
            if pack != at:
                at, segment, offset, path, here = pack, 0, 0, [], None
            if place != here:
                here = place
                del path[shared:]
            parent = path[-1][0] if path else -1
            if text is None:
                out.append((pack, segment, parent, True, conv, None, None, None, None, None, None))
            else:
                seen = []
                if path:
                    _, start, stop, seen = path[-1]
                    seen = [*seen[:-1], (seen[-1][0], stop)] if seen and seen[-1][1] == start else [*seen, (start, stop)]
                path.append((segment, offset, offset + len(text), seen))
                loss = (None, None) if loss_from is None else (offset + loss_from, offset + loss_to)
                out.append((pack, segment, parent, False, None, text, offset, position, [{"start": a, "stop": b} for a, b in seen], *loss))
                offset += len(text)
            segment += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def write_chats(conversations: DataFrame, path: str, pack_chars: int = PACK) -> None:
    """Writes conversations (conv_id, turn, role, text) as packs of prefix trees to ``path``.

    The rows written are a pack's nodes, and a leaf for each conversation whose ``parent`` is the
    node of its last turn, both in depth-first order (``segment``).  A node has ``text``, its offset
    ``start`` in the pack's text (the nodes' texts in order), ``position``, the number of characters
    before it in its conversations, ``attends``, the pack's intervals of its ancestors, and, for a
    turn of the assistant, the interval of its text that is learned from.

    Turns are ordered by ``turn``, nulls last, ties by role and text.  Null texts and roles count as
    empty; rows of a null conv_id are one conversation.  Repeated rows are turns of their own.  Other
    columns are not read.  An empty table writes no rows.  A pack holds ``pack_chars`` characters, or
    one conversation that is longer; nodes shared by conversations of several packs are written in
    each.  A task holds the hashes of one conversation's turns, and no text but a batch's.
    """
    turns_path, packs_path = (new_path(conversations.sparkSession, n) for n in ("turns", "packs"))
    spark = conversations.sparkSession
    written_turns(conversations).write.parquet(turns_path)
    turns = spark.read.parquet(turns_path)
    packs_of(turns.select("conv_id", "seq", "p1", "p2", "size"), pack_chars).write.parquet(packs_path)
    packs = spark.read.parquet(packs_path)
    own = packs.withColumnRenamed("conv_id", "own")
    new = turns.join(own, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("seq") > F.col("shared")))
    nodes = new.select("pack", "place", "seq", "shared", "conv_id", "text", "position", "loss_from", "loss_to")
    none = F.lit(None)
    leaves = packs.select("pack", "place", (F.col("n") + 1).alias("seq"), "shared", "conv_id", none.cast("string"), none.cast("bigint"), none.cast("bigint"), none.cast("bigint"))
    nodes.union(leaves).repartition("pack").sortWithinPartitions("pack", "place", "seq").mapInArrow(_building, NODES).write.parquet(path)


def _reading(batches: Iterator) -> Iterator:
    """Digests of conversations from nodes and leaves in order; a node's hashes go on from its parent's."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(READ)
    at = None
    for batch in batches:
        out = []
        for row in zip(*[batch.column(c) for c in range(batch.num_columns)], strict=True):
            pack, segment, parent, leaf, conv, text, start, loss_start, loss_stop = (x.as_py() for x in row)
            if pack != at:
                at, path = pack, [(-1, hashlib.sha256(), hashlib.sha256(), 0, 0, 0)]
            while path[-1][0] != parent:
                path.pop()
            _, turns, loss, n, learned, size = path[-1]
            if leaf:
                out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), size))
                continue
            role, said = parsed(text)
            turns, loss = turns.copy(), loss.copy()
            turns.update(f"{role}\n{said}\n".encode())
            if loss_start is not None:
                taught = plain(text[loss_start - start : loss_stop - start])
                loss.update(taught.encode())
                learned += len(taught)
            path.append((segment, turns, loss, n + 1, learned, size + len(text)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation of the packs at ``path``: turns, digests of the turns and of the text learned from, and sizes.

    ``turns_sha256`` is that of role, line feed, text, line feed of each turn, ``loss_sha256`` that of
    the text under the loss mask, unescaped; sizes are in code points.  A pack is read in order, each
    shared turn once.
    """
    columns = ["pack", "segment", "parent", "leaf", "conv_id", "text", "start", "loss_start", "loss_stop"]
    packs = spark.read.schema(NODES).parquet(path).select(*columns)
    return packs.repartition("pack").sortWithinPartitions("pack", "segment").mapInArrow(_reading, READ)


def expanded(nodes: list) -> tuple[str, list[int], list[list[tuple[int, int]]], list[bool]]:
    """A pack's text, and for each character its position, the intervals that it attends to, and whether it is learned from.

    ``nodes`` are the pack's nodes in order.  This is what a trainer makes of a pack: positions and
    masks of all characters, from the few numbers that a node carries.
    """
    text, positions, masks, learned = [], [], [], []
    for n in nodes:
        text.append(n.text)
        for i in range(len(n.text)):
            here = n.start + i
            positions.append(n.position + i)
            masks.append([(a.start, a.stop) for a in n.attends] + [(n.start, here + 1)])
            learned.append(n.loss_start is not None and n.loss_start <= here < n.loss_stop)
    return "".join(text), positions, masks, learned


def op12_prefix_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template, formatted and read back."""
    own = [(-1, k, role, f"{CLOSE}[INST] ok [/INST]") for k, role in enumerate(("user", LEARNED))]
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    path = new_path(spark, "chats")
    write_chats(given.unionByName(spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string")), path)
    return read_chats(spark, path)


OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLOSE}[INST] ok [/INST]' UNION ALL SELECT -1, 1, '{LEARNED}', '{CLOSE}[INST] ok [/INST]'),
e AS (SELECT *, {{0}} AS erole, {{1}} AS etext FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(NAMED) + len(CLOSE)} + length(erole) + length(etext)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
""".format(*[
    # Each backslash is one character more, and so is each control string that is broken.
    f"regexp_replace(regexp_replace({x}, '\\\\', '\\\\\\\\', 'g'), '<(/?s>)|\\[(/?INST\\])', '__\\1\\2', 'g')" for x in ("role", "text")
])
