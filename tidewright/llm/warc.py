"""WARC archives: a writer, and a splittable reader (operator 3).

Each record is a gzip member of its own.  The writer builds members in tasks and lets
Spark's text sink write them, so that files are committed like any other output and may lie in
any store.  (The sink ends every value with a separator byte.  A member ends with the high
byte of its length, which is 0 below 16 MiB; that byte is left to the
separator.  Longer records get an empty member after them, which ends in 0 as well.)

The reader plans byte ranges.  A task looks for gzip magic in its range, validates a candidate by
decoding its header as WARC and the member as a whole, and owns the records that start inside the
range; from a valid member on it goes from member to member, past the end of the range for the last one.
What looks like a member may lie within the payload of another.  So a first pass notes, for each range, the first
member found and where the chain of members leaves the range; then, file by file, the chain is followed from the
beginning of the file: the members of a range start where the chain of the range before has led.  A range that had found
another start (a member in a payload) is walked again from there.  Records come out as if each file were read
from its beginning, whatever the size of the ranges.

Payloads: of records with equal payloads of at least ``dedup_bytes`` bytes the one with the smallest
id is a response, others revisit it (no payload stored).  Equal means: equal SHA-1 and length.

Archives of others: a digest that is missing or of another algorithm than SHA-1 isn't checked (``digest_ok`` null; false
if it differs), the digest of a stored payload is always the SHA-1 of what was read; a bad ``Content-Length`` means all of the
member; the payload is what follows the HTTP header of a response, and the block of other records except revisits;
the length of a revisited payload is null unless an extension field has it; bytes between members are skipped.  Archives
that aren't compressed by member aren't split into records: only gzip members that begin with a WARC header count.

Results: a null payload is empty; null urls are stored as empty; repeated rows with the smallest id
are all responses; rows with a null id never become the response of others and keep a null id; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import cut, work_folder

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RANGE = 32 << 20
STEP = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "file string, offset long, record_type string, record_id string, target_uri string, payload_digest string, refers_to_id string, payload_bytes long, payload binary, digest_ok boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, uri: str, digest: str, size: int, refers: str | None, payload: bytes | None) -> bytes:
    """Bytes of one record; ``WARC-Payload-Length`` is an extension field."""
    block = _HTTP + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub('[\r\n]', ' ', uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, dedup_bytes: int = 0, *, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Adds ``digest`` (hex), ``size`` and ``first_id``: the response that a row revisits, else null.

    Only payloads that occur twice or more are joined back.  One payload may make up a third of all rows: those with over a
    thousandth of the repeated rows (fewer than a thousand payloads) are broadcast, and their rows are
    spread by id.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), *( [F.col("url")] if "url" in pages.columns else [F.lit("").alias("url")]), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    shared = cut(rows.where(F.col("size") >= dedup_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL"))
    often = (shared.agg(F.sum("n")).first()[0] or 0) // 1000
    named = lambda df, p: df.select(F.concat("digest", F.lit("/"), F.col("size").cast("string")).alias(f"{p}_key"), F.col("first_id").alias(f"{p}_first"))
    hot, cold = named(shared.where(F.col("n") > max(1000, often)), "hot"), named(shared.where(F.col("n") <= max(1000, often)), "cold")
    key = F.concat("digest", F.lit("/"), F.col("size").cast("string"))
    told = rows.withColumn("key", key).join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    spread = F.when(F.col("hot_key").isNull(), F.col("key")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    joined = told.withColumn("key", spread).join(cold, F.col("key") == F.col("cold_key"), "left").withColumn("first_id", F.coalesce("hot_first", "cold_first"))
    return joined.select("page_id", "url", "body", "digest", "size", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("first_id"))


def write(pages: DataFrame, path: str, dedup_bytes: int = 0, **names) -> None:
    """Writes one record per row to archives in ``path``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for page, url, body, digest, size, first in zip(*(part[c] for c in ("page_id", "url", "body", "digest", "size", "first_id")), strict=True):
                first, page = first.as_py(), page.as_py()
                sha = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                payload = None if first is not None else body.as_py()
                refers = None if first is None else f"urn:page:{first}"
                data = member(record("response" if first is None else "revisit", f"urn:page:{'' if page is None else page}", url.as_py() or "", sha, size.as_py(), refers, payload))
                if data[-1]:
                    data += EMPTY
                out.append(data[:-1])
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    members = roles(pages, dedup_bytes, **names).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


class _Stream:
    """Bytes of a file from an offset on, read in steps."""

    def __init__(self, f, offset: int):
        self.f, self.at, self.buffer = f, offset, b""
        f.seek(offset)

    def more(self) -> bool:
        data = self.f.read(STEP)
        self.buffer += data
        return bool(data)

    def drop(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        self.at += n


def _decode(s: _Stream, header_only: bool = False) -> tuple[bytes, int] | None:
    """Content and length of the member at the beginning of the stream; None if it isn't one."""
    z, out, used = zlib.decompressobj(31), [], 0
    try:
        while not z.eof:
            if used == len(s.buffer) and not s.more():
                return None
            out.append(z.decompress(s.buffer[used:]))
            used = len(s.buffer)
            if header_only and sum(map(len, out)) >= 5:
                return b"".join(out), 0
    except zlib.error:
        return None
    return b"".join(out), used - len(z.unused_data)


def _fields(data: bytes) -> tuple[dict[str, str], bytes] | None:
    if not data.startswith(b"WARC/"):
        return None
    head, found, block = data.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", "")
    return fields, block[: int(size)] if re.fullmatch("[0-9]+", size) else block.removesuffix(b"\r\n\r\n")


def walk(f, start: int, end: int, chained: bool = False) -> Iterator[tuple[int, int, tuple[dict[str, str], bytes] | None]]:
    """Members that start in [start, end) of an open file: offset, end, fields and block (None: a member that isn't a record).

    ``chained``: a member is known to end at ``start``.
    """
    s = _Stream(f, start)
    while s.at < end:
        if len(s.buffer) < 3:
            s.more()
        if not s.buffer:
            return
        if not s.buffer.startswith(MAGIC):
            chained = False
            found = s.buffer.find(MAGIC, 1)
            if found < 0:
                keep = min(len(s.buffer), 2)
                s.drop(len(s.buffer) - keep)
                if not s.more():
                    return
                continue
            s.drop(found)
            continue
        head = _decode(s, header_only=True)
        whole = _decode(s) if head is not None and (chained or head[0].startswith(b"WARC/")) else None
        parsed = _fields(whole[0]) if whole is not None else None
        if whole is None or (parsed is None and not chained):
            chained = False
            s.drop(1)
            continue
        yield s.at, s.at + whole[1], parsed
        s.drop(whole[1])
        chained = True


def read_range(f, start: int, end: int, chained: bool = False) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in [start, end) of an open file: offset, fields, block."""
    for at, _, parsed in walk(f, start, end, chained):
        if parsed is not None:
            yield at, *parsed


def survey(f, start: int, end: int, chained: bool = False) -> tuple[int | None, int | None]:
    """Where the first member in the range begins, and where the last one ends."""
    first = last = None
    for at, stop, _ in walk(f, start, end, chained):
        first, last = at if first is None else first, stop
    return first, last


def settle(found: list[tuple[int, int, int | None, int | None]], again) -> list[tuple[int, int, int, bool]]:
    """Of a file's ranges (start, end, first, last) in order: where reading begins, where it ends, and whether a member ends there.

    ``again(start, end)`` surveys a range from a known end of a member.
    """
    out, reach = [], 0
    for start, end, first, last in found:
        begin, chained = max(start, reach), reach > start or reach == start > 0
        if begin < end and chained and first != begin:
            first, last = again(begin, end)
        if begin < end:
            out.append((start, end, begin, chained))
            if first is not None:
                reach = last
    return out


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``file, start, end`` of all byte ranges of the archives in a folder; names and lengths only are read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.col("path").alias("file"), F.col("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)),
        F.lit(size).cast("long"))).alias("start")).select(
        "file", "start", F.least(F.col("start") + size, F.col("length")).alias("end")
    )


def opened(uri: str):
    """An open file; a context manager."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return store.open_input_file(name)


def read(spark: SparkSession, path: str, size: int = RANGE, payload: bool = True) -> DataFrame:
    """All records (``RECORDS``) of the archives in a folder.

    Tasks open archives with Arrow's file systems (local, HDFS, S3, GCS).
    """
    # one small row per range: dealt out evenly, because the listing is a single partition
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen = []
            for file, start, end in zip(part["file"].to_pylist(), part["start"].to_pylist(), part["end"].to_pylist(), strict=True):
                with opened(file) as f:
                    seen.append(survey(f, start, end))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.int64())], names=["file", "start", "end", "first", "last"])

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        file = t["file"][0].as_py()

        def again(start: int, end: int) -> tuple[int | None, int | None]:
            with opened(file) as f:
                return survey(f, start, end, chained=True)

        told = settle(list(zip(*(t[c].to_pylist() for c in ("start", "end", "first", "last")), strict=True)), again)
        columns = [pa.array([file] * len(told), pa.string()), pa.array([x[2] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[3] for x in told], pa.bool_())]
        return pa.table(columns, names=["file", "start", "end", "chained"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, start, end, chained in zip(*(part[c].to_pylist() for c in ("file", "start", "end", "chained")), strict=True):
                out, held = [], 0
                with opened(file) as f:
                    for at, fields, block in read_range(f, start, end, chained):
                        out.append((file, at, *described(fields, block, payload)))
                        held += len(block)
                        if held > 16 << 20:
                            yield _records(out)
                            out, held = [], 0
                if out:
                    yield _records(out)

    looked = ranges(spark, path, size).repartition(tasks, "file", "start").mapInArrow(look, "file string, start long, end long, first long, last long")
    # a row per range: a file's ranges are few
    settled = looked.groupBy("file").applyInArrow(follow, "file string, start long, end long, chained boolean")
    return settled.repartition(tasks, "file", "start").mapInArrow(run, RECORDS)


def described(fields: dict[str, str], block: bytes, payload: bool) -> tuple:
    """The columns of a record from ``record_type`` on."""
    kind = fields.get("warc-type", "")
    algorithm, _, told = fields.get("warc-payload-digest", "").partition(":")
    body = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if kind == "response" else block
    digest, ok, length = told, None, fields.get("warc-payload-length", "")
    if body is not None:
        digest = base32_sha1(body)
        if algorithm.lower() == "sha1" and told:
            ok = told.upper() == digest or told.lower() == hashlib.sha1(body).hexdigest()
    size = len(body) if body is not None else int(length) if re.fullmatch("[0-9]+", length) else None
    refers = fields.get("warc-refers-to", "").strip("<>") or None
    return kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri", ""), digest, refers, size, body if payload else None, ok


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, dedup_bytes: int = 0, size: int = RANGE, folder: str | None = None, **names) -> DataFrame:
    """Writes archives to the shared folder and reads them back: one row per record."""
    spark = pages.sparkSession
    path = folder or f"{work_folder(spark, 'warc')}/archives"
    write(pages, path, dedup_bytes, **names)
    page = lambda c: F.expr(f"CAST(nullif(substring({c}, 10), '') AS BIGINT)")  # noqa: E731  after urn:page:
    return read(spark, path, size, payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), 0)


# Five hexadecimal digits are four digits of base 32.
_FOUR = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))
ORACLE = {
    "op3_warc": f"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS b, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
v AS (SELECT k, i, ('0x' || substr(sha1(b), i * 5 + 1, 5))::INT AS v FROM p, (SELECT unnest(range(0, 8)) AS i)),
g AS (SELECT k, string_agg({_FOUR}, '' ORDER BY i) AS digest FROM v GROUP BY k)
SELECT page_id, octet_length(encode(b)) AS payload_bytes, digest AS payload_digest,
CASE WHEN f IS NULL OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> coalesce(page_id, -1) THEN f END AS refers_to
FROM p JOIN g USING (k)
"""
}
