"""WARC archives: writing segmented records, and reassembling and decoding them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, table

#: Bytes of a record's block after which it goes on in a continuation record.
SEGMENT_BYTES = 32_768
#: Bytes of a chunk of the chunked transfer coding.
CHUNK_BYTES = 8_192
#: Records of an archive file; with the segments this bounds a file's size.
FILE_RECORDS = 2_000
#: The date written where a page has none; pages carry no time.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32, without a prefix."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def _records(segment_bytes: int, chunk_bytes: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                out = []
                for row in whole.slice(at, 200).to_pylist():
                    url = re.sub(r"[\x00-\x20\x7f]", "", row["url"]) if row["url"] is not None else None
                    common = [("WARC-Record-ID", f"<{row['record']}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", row["page"])]
                    common.append(("WARC-Payload-Digest", f"sha1:{row['digest']}"))
                    if row["refers"] is not None:
                        block = _HTTP + b"\r\n"
                        fields = [("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers']}>")]
                        out.append(_header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block)
                        continue
                    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"], chunk_bytes)
                    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                    for n, part in enumerate(parts, 1):
                        if n == 1:
                            fields = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
                        else:
                            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{row['record']}:{n}>"), ("WARC-Date", DATE)]
                            fields.append(("WARC-Segment-Origin-ID", f"<{row['record']}>"))
                        if len(parts) > 1:
                            fields.append(("WARC-Segment-Number", n))
                            if n == len(parts):
                                fields.append(("WARC-Segment-Total-Length", len(block)))
                        out.append(_header([*fields, ("Content-Length", len(part))]) + part)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    min_revisit_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Writes gzipped WARC 1.1 archives with a record for each page.

    The payload is the html in UTF-8 (null: empty), framed as chunks; a block of more than
    ``segment_bytes`` goes on in continuation records.  Of the pages with equal payloads of at
    least ``min_revisit_bytes`` bytes, that with the largest id is a response and the others are
    revisits that refer to it; rows that share that id and payload are all responses.  A page
    with a null id revisits any equal page that has an id, and is a response where there is none.
    A null url leaves out the target, other columns are left out, no pages give no records.

    Originals are found by a max for each digest, which combines on the map side; pages then join
    it by digest, where Spark splits the digests that very many pages share.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("n")
    )
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(":"), F.col("n").cast("string"))
    rows = rows.select("page", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), name.alias("record"))
    known = rows.where(F.col("page").isNotNull() & (F.octet_length("payload") >= min_revisit_bytes))
    best = known.groupBy("digest").agg(F.max(F.struct("page", "record")).alias("best"), F.count("*").alias("n"))
    best = best.select(F.col("digest").alias("same"), "best")
    joined = rows.join(best, F.col("digest") == F.col("same"), "left")
    later = F.col("best").isNotNull() & ~F.col("page").eqNullSafe(F.col("best.page"))
    refers = F.when(later & (F.octet_length("payload") >= min_revisit_bytes), F.col("best.record"))
    joined = joined.select("page", "url", "payload", "digest", "record", refers.alias("refers"))
    records = joined.mapInArrow(_records(segment_bytes, chunk_bytes), "record binary")
    # A record ends with two line ends, which the text writer puts after each row; the bytes of a
    # row are written as they are.
    (
        records.select(F.col("record").cast("string"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


def _parse(batches) -> Iterator:
    """The records of gzipped archives, streamed: only one record is held at a time."""
    import pyarrow as pa

    kinds = pa.schema(
        [("record", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page", pa.int64()), ("refers", pa.string()), ("block", pa.binary())]
    )

    def unpacked(data: bytes) -> Iterator[bytes]:
        while data:
            one = zlib.decompressobj(31)
            for i in range(0, len(data), 1 << 20):
                yield one.decompress(data[i : i + (1 << 20)])
                if one.eof:
                    data = one.unused_data + data[i + (1 << 20) :]
                    break
            else:
                raise ValueError("an archive is cut off")

    def records(data: bytes) -> Iterator[dict]:
        held = bytearray()
        parts = unpacked(data)

        def fill(n: int) -> bool:
            while len(held) < n:
                more = next(parts, None)
                if more is None:
                    return False
                held.extend(more)
            return True

        while True:
            while (stop := held.find(b"\r\n\r\n")) < 0:
                more = next(parts, None)
                if more is None:
                    if held.strip():
                        raise ValueError("a record's header is cut off")
                    return
                held.extend(more)
            lines = bytes(held[:stop]).decode().split("\r\n")
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = int(fields["content-length"])
            if not fill(stop + 4 + size):
                raise ValueError("a record's block is cut off")
            block = bytes(held[stop + 4 : stop + 4 + size])
            fill(stop + 8 + size)
            del held[: stop + 8 + size]
            ident = fields["warc-record-id"].strip("<>")
            number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
            page, refers = fields.get("page-id"), fields.get("warc-refers-to")
            yield {
                "record": ident, "kind": fields["warc-type"], "origin": fields.get("warc-segment-origin-id", ident).strip("<>"),
                "number": int(number) if number else None, "total": int(total) if total else None,
                "page": int(page) if page else None, "refers": refers.strip("<>") if refers else None, "block": block,
            }

    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for row in records(data.as_py()):
                rows.append(row)
                size += len(row["block"])
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _decoded(batches) -> Iterator:
    """Joins each record's segments, verifies them and undoes the framing."""
    import pyarrow as pa

    kinds = pa.schema([("record", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def row(x: dict) -> dict:
        payload, error = None, None
        segments = sorted(x["segments"], key=lambda s: s["number"] or 1)
        numbers, totals = [s["number"] or 1 for s in segments], [s["total"] for s in segments if s["total"] is not None]
        block = b"".join(s["block"] for s in segments)
        if numbers != list(range(1, len(numbers) + 1)) or (segments[0]["number"] is not None and not totals):
            error = "a segment is missing or there twice"
        elif totals and totals[-1] != len(block):
            error = "the segments' length differs from the total"
        elif x["kind"] == "response":
            head, _, body = block.partition(b"\r\n\r\n")
            try:
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError as e:
                error = str(e)
        return {"record": x["record"], "record_type": x["kind"], "page_id": x["page"], "refers": x["refers"], "payload": payload, "error": error}

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield pa.RecordBatch.from_pylist([row(x) for x in batch.slice(at, 200).to_pylist()], schema=kinds)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of gzipped archives, reassembled and decoded.

    Continuation records are grouped by their origin's identifier and ordered by number; the
    total length is verified and the chunked framing undone.  Records of one segment need no
    grouping.  Returns (record, record_type, page_id, refers, payload, error): ``error`` tells
    of missing or surplus segments, a wrong total or broken chunks, where ``payload`` is null;
    continuations without an origin come with a null record_type and an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(
        _parse, "record string, kind string, origin string, number int, total bigint, page bigint, refers string, block binary"
    ).where("kind in ('response', 'revisit', 'continuation')")
    segment = F.struct("number", "total", "block")
    alone = found.where("number is null and kind <> 'continuation'").select("record", "kind", "page", "refers", F.array(segment).alias("segments"))
    first = [F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in ("kind", "page", "refers")]
    cut = found.where("number is not null or kind = 'continuation'").groupBy("origin").agg(*first, F.collect_list(segment).alias("segments"))
    cut = cut.select(F.col("origin").alias("record"), "kind", "page", "refers", "segments")
    return alone.unionByName(cut).mapInArrow(
        _decoded, "record string, record_type string, page_id bigint, refers string, payload binary, error string"
    )


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error): revisits take the
    payload's size and digest from the response they refer to, and that response's page."""
    sized = records.select(
        "record", "record_type", "page_id", "refers", "error",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    responses = sized.where("record_type = 'response'").select(
        F.col("record").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")
    )
    revisits = sized.where("record_type = 'revisit'").join(responses, F.col("refers") == F.col("target"), "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    return (
        sized.where("record_type is null or record_type <> 'revisit'")
        .withColumn("refers_to", F.lit(None).cast("bigint"))
        .select(*cols)
        .unionByName(revisits.withColumns({"payload_bytes": F.col("b"), "payload_digest": F.col("d")}).select(*cols))
    )


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as read back from archives written of all pages."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path)).drop("error")


_BASE32 = " || ".join(f"to_base(CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT), 32, 8)" for i in range(4))
OP9_SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, n, translate(upper({_BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest,
    max(page_id) OVER (PARTITION BY h) AS best FROM hashed)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to FROM named
"""
