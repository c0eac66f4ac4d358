"""WARC archives: writing records with segments and chunked framing, reading them back, and reassembling segments.

Archives go through Spark's own file sinks and sources, so any store Spark knows will do. Records are built from byte
expressions in the JVM; only parsing and de-chunking run in Python, an Arrow batch at a time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm._common import put, read, shared_dir, stash

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD_SCHEMA = "record_id string, warc_type string, key string, target_uri string, digest string, refers_key string, segment int, origin_id string, total_length long, block binary"
#: Bytes of records handed over at once by the parser.
FLUSH_BYTES = 16 << 20


def _chunked(body: Column, size: int) -> Column:
    """HTTP/1.1 chunked transfer framing of a binary column."""
    n = F.octet_length(body)
    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)),
        lambda at: F.concat(F.lower(F.hex(F.least(F.lit(size), n - at + 1))), F.lit("\r\n"), F.substring(body, at, F.lit(size)).cast("string"), F.lit("\r\n")),
    )
    return F.concat(F.when(n > 0, F.array_join(pieces, "")).otherwise(F.lit("")), F.lit("0\r\n\r\n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, k) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * (i > 0) + [F.substring(h, a, k)])], F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; control characters cannot break out of a line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def records_of(df: DataFrame, *, key_col: str, payload_col: str, uri_col: str, date: str, min_revisit_bytes: int, segment_bytes: int, chunk_bytes: int) -> DataFrame:
    """One row (column value) for each WARC record, ready for the text sink; see `write`."""
    body = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{uri_col}`").cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body"), "digest": F.sha1("body"), "other": F.md5("body")})
    # Payloads are equal when length and both digests are; only classes of several keys matter, and their table is read
    # back with its size known, so that the planner broadcasts it only below its limit.
    classes = rows.filter(F.col("n") >= min_revisit_bytes).groupBy("digest", "other", "n").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("k"))
    multi = stash(classes.filter("k > 1").select("digest", "other", "n", "keep"), "equal-payloads")
    rows = rows.join(multi, ["digest", "other", "n"], "left")
    revisit = F.coalesce(F.col("keep").isNotNull() & ~F.col("key").eqNullSafe(F.col("keep")), F.lit(False))
    http = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(_chunked(F.col("body"), chunk_bytes)))
    rows = rows.select("key", "uri", "digest", revisit.alias("revisit"), "keep", _urn(F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("digest"), F.monotonically_increasing_id().cast("string")).alias("id"), http.cast("binary").alias("http"))
    rows = rows.withColumn("total", F.octet_length("http"))
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("total") / segment_bytes).cast("int")))))
    split, last = F.col("total") > segment_bytes, F.col("seg") * segment_bytes >= F.col("total")
    first = F.col("seg") == 1
    block = F.substring(F.col("http"), (F.col("seg") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\n"),
        _field("WARC-Record-ID", F.when(first, F.col("id")).otherwise(_urn(F.col("id"), F.col("seg").cast("string")))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("X-Record-Key", F.when(first, F.col("key").cast("string"))),
        _field("WARC-Profile", F.when(first & F.col("revisit"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _field("X-Refers-To-Key", F.when(first & F.col("revisit"), F.col("keep").cast("string"))),
        _field("WARC-Segment-Number", F.when(split, F.col("seg").cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(split & ~first, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(split & last, F.col("total").cast("string"))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block.cast("string")).alias("value"))


def write(df: DataFrame, path: str, *, key_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 1000, segment_bytes: int = 8192, chunk_bytes: int = 4096, records_per_file: int = 5000) -> None:
    """Writes gzip-compressed archives to a folder, one record or more for each row.

    HTTP messages over `segment_bytes` are split: the first record holds segment 1, `continuation` records the others, the
    last of which has the total length. Of equal payloads of `min_revisit_bytes` or more the largest key (each row of it) is a
    response and others are revisits without payload. Null payloads are empty, null keys are written without a key and
    are responses unless their payload is another key's; an empty table gives an empty folder.
    """
    out = records_of(df, key_col=key_col, payload_col=payload_col, uri_col=uri_col, date=date, min_revisit_bytes=min_revisit_bytes, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
    # A record ends with two line breaks, which is what the text sink puts after each row.
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def _plain(content: bytes) -> bytes:
    """Decompresses gzip members one after another; plain archives pass."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        parts += [z.decompress(content), z.flush()]
        content = z.unused_data
    return b"".join(parts)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, as RECORD_SCHEMA has them. A record cut off by the archive's end has the fields that are there and no
    block."""
    at, end = 0, len(data)
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        stop = data.find(b"\r\n\r\n", at)
        if at >= end:
            return
        cut = stop < 0
        stop = end if cut else stop
        head: dict[str, str] = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head.get("content-length") or 0)
        block = data[stop + 4 : stop + 4 + length]
        cut = cut or len(block) < length
        number = lambda x: int(x) if x and x.isdigit() else None
        digest = head.get("warc-payload-digest")
        yield (head.get("warc-record-id"), head.get("warc-type"), head.get("x-record-key"), head.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), head.get("x-refers-to-key"),
               number(head.get("warc-segment-number")), head.get("warc-segment-origin-id"), number(head.get("warc-segment-total-length")), None if cut else block)
        at = stop + 4 + length


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for row in parse(_plain(content.as_py())):
                rows.append(row)
                held += len(row[-1] or b"")
                if held >= FLUSH_BYTES:
                    yield _arrow(rows)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder. An archive is held in memory while it is parsed; `write` bounds
    its records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(_parse_batches, RECORD_SCHEMA)


def dechunk(message: bytes) -> tuple[bytes | None, str]:
    """The payload of an HTTP message and `ok`, or null and what is wrong with it."""
    stop = message.find(b"\r\n\r\n")
    if stop < 0:
        return None, "no http header"
    body = message[stop + 4 :]
    if b"transfer-encoding: chunked" not in message[:stop].lower():
        return body, "ok"
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            n = int(body[at:line].split(b";")[0], 16) if line > at else -1
        except ValueError:
            n = -1
        if n < 0 or len(body) < line + 2 + n + 2 or body[line + 2 + n : line + 4 + n] != b"\r\n":
            return None, "broken chunk"
        if n == 0:
            return b"".join(parts), "ok"
        parts.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(None, s) if s != "ok" else (b"", "ok") if t == "revisit" else dechunk(m or b"") for t, s, m in zip(batch.column("warc_type").to_pylist(), batch.column("status").to_pylist(), batch.column("message").to_pylist(), strict=True)]
        keep = ["record_id", "warc_type", "key", "target_uri", "digest", "refers_key"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(pa.string()) for c in keep], pa.array([p for p, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())], names=[*keep, "payload", "status"])


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each logical record: record_id, warc_type, key, target_uri, digest, refers_key, payload, status.

    Segments are grouped by the identifier of their origin, put in the order of their numbers and joined; the length must be
    the total that the last segment states, and numbers must run from 1 without gap or conflict. Status is `ok`, `no
    first segment`, `missing segment`, `conflicting segments`, `truncated` (a record that the end of its archive cuts off), `wrong length`, or what the chunked framing lacks; the
    payload is null unless it is `ok`. Byte-equal repetitions of a segment count once. Whole records bypass the grouping.
    A group is one message, which must fit in memory in any case.
    """
    columns = ["record_id", "warc_type", "key", "target_uri", "digest", "refers_key"]
    whole = records.filter("segment IS NULL AND warc_type IN ('response', 'revisit')").select(*columns, F.when(F.col("block").isNull(), "truncated").otherwise("ok").alias("status"), F.col("block").alias("message"))
    seg = records.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    parts = seg.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in columns],
    )
    numbers, n = F.col("parts.segment"), F.size("parts")
    joined = F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary")
    status = (
        F.when(numbers[0] != 1, "no first segment")
        .when(F.size(F.array_distinct(numbers)) < n, "conflicting segments")
        .when((numbers[n - 1] != n) | F.col("total").isNull(), "missing segment")
        .when(F.exists("parts", lambda x: x["block"].isNull()), "truncated")
        .when(F.octet_length(joined) != F.col("total"), "wrong length")
        .otherwise("ok")
    )
    split = parts.select(F.coalesce("record_id", "origin").alias("record_id"), *columns[1:], status.alias("status"), joined.alias("message"))
    return whole.unionByName(split).mapInArrow(_payloads, "record_id string, warc_type string, key string, target_uri string, digest string, refers_key string, payload binary, status string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quadlake/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    whole = reassemble(read_records(spark, path))
    response = F.col("warc_type") == "response"
    rows = stash(whole.select(F.col("key").cast("long").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).alias("bytes"), F.when(response, F.sha1("payload")).alias("sha"), F.col("digest"), F.col("warc_type").alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"), F.col("target_uri").alias("url"), "status"), "warc-rows")
    # A revisit gets length and digest of the response it names.
    kept = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("sha").alias("to_sha")).agg(F.max("bytes").alias("to_bytes"))
    out = rows.filter("record_type = 'revisit'").join(kept, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("to_sha")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "status"]
    revisits = put(out, payload_bytes=F.col("to_bytes"), payload_digest=F.col("to_sha")).select(*columns)
    return put(rows.filter("record_type = 'response'"), payload_bytes=F.col("bytes"), payload_digest=F.col("sha")).select(*columns).unionByName(revisits)


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS n, sha1(h) AS sha, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to, url, 'ok' AS status
FROM d
"""
