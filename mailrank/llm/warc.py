"""WARC archives with a two-level capture index.

Captures are ranged by their reversed-host URL key, so one host of any size is written by many
tasks. Each task writes one archive of gzip members, in key order, and next to it an index of
compressed blocks of capture lines; a block covers captures that lie next to each other in the
archive. The sparse directory, a Parquet table, has one row for each block with its first and
last key. A lookup searches the directory, then by bisection the lines of the blocks that may
hold a key, and reads only the byte range of the archive it needs. Files carry a name of their
own for each attempt and count only once the directory lists them, so a task that is lost or
runs twice leaves no half-written capture behind. Many URLs are looked up as a table: they go to
their archives by the archives' bounds, and there to blocks and lines by bisection.

Of captures with equal payloads (SHA-1 and length) of at least ``MIN_DEDUP`` bytes, the one of
the largest id is the response and the others revisit it.

Nulls and ties: a null page is an empty payload, a null URL an empty one; line breaks and other
control characters in URLs are percent-encoded in headers. If several rows have the largest id
of a payload, all of them are responses; null ids are smaller than others. Payloads all of
whose ids are null are responses. An empty table gives an empty directory. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, table
from mailrank.session import fresh_path

MIN_DEDUP = 1000
BLOCK_LINES = 256
BLOCK_BYTES = 4 * 1024 * 1024  # of archive that one index block covers at most, or one longer record
DATE = "2000-01-01T00:00:00Z"  # the given tables know no capture time
DIRECTORY = (
    "first_key string, last_key string, archive string, index string, "
    "index_offset bigint, index_length bigint, archive_offset bigint, archive_length bigint, n_captures int"
)


def store(path: str):
    """File system and folder for a path of the shared folder, of any kind that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, ``)``, then path and query; other texts unchanged.

    Control characters become ``?``, so that a key fits into a line of the index.
    """
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([\s\S]*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    key = F.when(url.rlike(pattern), F.concat(host, F.lit(")"), F.regexp_extract(url, pattern, 2))).otherwise(url)
    return F.regexp_replace(key, r"[\x00-\x1F\x7F]", "?")


def captures(pages: DataFrame) -> DataFrame:
    """``key, page_id, digest, n, url, payload, refers_to``: one row for each page with its payload, and
    before those that revisit another page a narrow row that says which (``payload`` is null there).

    What is equal is found on narrow rows, so payloads are moved only once, when archives are written.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload"), "key": url_key(F.col("url"))})
    narrow = rows.select("key", "page_id", "digest", "n").where(F.col("n") >= MIN_DEDUP)
    shared = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    shared = shared.where("copies > 1 and refers_to is not null").drop("copies")
    revisits = narrow.distinct().join(shared, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    kept = ["key", "page_id", "digest", "n", "url", "payload"]
    return revisits.select(*kept[:4], F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "refers_to").unionByName(
        rows.select(*kept, F.lit(None).cast("bigint").alias("refers_to"))
    )


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    name = "none" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = "response" if refers_to is None else "revisit"
    block = http + (b"Content-Length: %d\r\n\r\n" % len(payload)) + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(wbits=31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member, with the digest of the payload if it is there."""
    raw = zlib.decompress(member, wbits=31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.split(b"\r\n\r\n", 1)[1] if headers["WARC-Type"] == "response" else None
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        found = headers.get(name, "<urn:page:none>")[len("<urn:page:") : -1]
        return None if found == "none" else int(found)

    return {
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": int(headers["X-Payload-Length"]) if payload is None else len(payload),
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload": payload,
    }


class _Archive:
    """Writes one archive and its index; gives the directory rows."""

    def __init__(self, folder: str):
        self.files, root = store(folder)
        name = uuid.uuid4().hex
        self.archive, self.index = f"{folder}/{name}.warc.gz", f"{folder}/{name}.cdx.z"
        self.out = self.files.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
        self.lines_out = self.files.open_output_stream(f"{root}/{name}.cdx.z", compression=None)
        self.at = self.index_at = self.start = 0
        self.lines: list[str] = []

    def add(self, key: str, member: bytes) -> dict | None:
        done = self.close_block() if self.lines and (len(self.lines) >= BLOCK_LINES or self.at + len(member) - self.start > BLOCK_BYTES) else None
        self.lines.append(f"{key}\t{self.at - self.start}\t{len(member)}")
        self.out.write(member)
        self.at += len(member)
        return done

    def close_block(self) -> dict:
        packed = zlib.compress("\n".join(self.lines).encode())
        self.lines_out.write(packed)
        row = {
            "first_key": self.lines[0].split("\t")[0],
            "last_key": self.lines[-1].split("\t")[0],
            "archive": self.archive,
            "index": self.index,
            "index_offset": self.index_at,
            "index_length": len(packed),
            "archive_offset": self.start,
            "archive_length": self.at - self.start,
            "n_captures": len(self.lines),
        }
        self.index_at += len(packed)
        self.start, self.lines = self.at, []
        return row

    def close(self) -> dict | None:
        row = self.close_block() if self.lines else None
        self.out.close()
        self.lines_out.close()
        return row


def write_archives(rows: DataFrame, folder: str) -> None:
    """Write ``captures`` rows below ``folder``; the directory is a table in ``folder/directory``."""
    spark = rows.sparkSession
    place = ["key", "page_id", "digest", "n"]
    # A narrow row, without a payload, comes before the rows it is about.
    rows = rows.select(*place, "payload", "url", "refers_to")
    rows = rows.repartitionByRange(parts(spark), *place).sortWithinPartitions(*place, F.col("payload").isNotNull())
    files, root = store(folder)
    files.create_dir(f"{root}/data", recursive=True)
    kinds = {f.name: pa.int32() if f.dataType.simpleString() == "int" else pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in spark.createDataFrame([], DIRECTORY).schema}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, told, target = None, None, None
        for batch in batches:
            done = []
            for key, page_id, digest, n, payload, url, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if payload is None:
                    told, target = (key, page_id, digest, n), refers_to
                    continue
                archive = archive or _Archive(f"{folder}/data")
                row = archive.add(key, record(page_id, url, payload.encode(), digest, target if told == (key, page_id, digest, n) else None))
                if row:
                    done.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if archive is not None:
            last = archive.close()
            if last:
                yield pa.RecordBatch.from_pylist([last], schema)

    in_arrow(rows, run, DIRECTORY).write.parquet(f"{folder}/directory")


def blocks_with(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """The directory's blocks that may hold a URL of ``urls`` (``url``), each with the ``keys`` asked of it.

    Archives cover ranges of keys, so a search of their bounds, of which there are as many as
    writing tasks, says which archive a key goes to; there it is searched among the archive's blocks.
    """
    directory = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    bounds = directory.groupBy("archive").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).toArrow().to_pylist()
    bounds = sorted((b["lo"].encode(), b["hi"].encode(), b["archive"]) for b in bounds)
    los = [b[0] for b in bounds]
    # Where the last keys of archives before are not below a key, it may be there as well.
    highest = [max((b[1] for b in bounds[: i + 1]), default=b"") for i in range(len(bounds))]
    sent = spark.sparkContext.broadcast((los, highest, bounds))
    keys = urls.select(url_key(F.coalesce("url", F.lit(""))).alias("key")).distinct()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        los, highest, bounds = sent.value
        for batch in batches:
            found, archives = [], []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                i = bisect.bisect_right(los, raw) - 1
                while i >= 0 and highest[i] >= raw:
                    if bounds[i][1] >= raw:
                        found.append(key)
                        archives.append(bounds[i][2])
                    i -= 1
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(archives, pa.string())], names=["key", "archive"])

    asked = in_arrow(keys, homes, "key string, archive string")
    columns = [c.split()[0] for c in DIRECTORY.split(", ")]

    def meet(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        # Keys of one archive; sorted by bytes, as its blocks are.
        keys = sorted(x.encode() for x in wanted["key"].to_pylist())
        rows = []
        for block in blocks.to_pylist():
            a = bisect.bisect_left(keys, block["first_key"].encode())
            b = bisect.bisect_right(keys, block["last_key"].encode())
            if a < b:
                rows.append([block[c] for c in columns] + [[k.decode() for k in keys[a:b]]])
        kinds = [*(blocks.schema.field(c).type for c in columns), pa.list_(pa.string())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*columns, "keys"])

    return directory.groupBy("archive").cogroup(asked.groupBy("archive")).applyInArrow(meet, f"{DIRECTORY}, keys array<string>")


def reads(lines: list[bytes], keys: list[bytes] | None) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring captures ``(offset, length)`` that an index block holds of the sorted ``keys``, found by bisection."""
    if keys is not None:
        own = [x.split(b"\t", 1)[0] for x in lines]
        lines = [y for k in keys for y in lines[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
    run: list[tuple[int, int]] = []
    for line in lines:
        at, n = map(int, line.split(b"\t")[1:])
        if run and at != run[-1][0] + run[-1][1]:
            yield run
            run = []
        run.append((at, n))
    if run:
        yield run


def read_block(block: dict, read: Callable[[str, int, int], bytes]) -> Iterator[dict]:
    """Records of one directory row, of its ``keys`` if there are any; ``read`` takes a path, an offset and a length."""
    lines = zlib.decompress(read(block["index"], block["index_offset"], block["index_length"])).split(b"\n")
    keys = None if block.get("keys") is None else [k.encode() for k in block["keys"]]
    for run in reads(lines, keys):
        start, end = run[0][0], run[-1][0] + run[-1][1]
        held = read(block["archive"], block["archive_offset"] + start, end - start)
        for at, n in run:
            yield parse_record(held[at - start : at - start + n])


def read_range(path: str, offset: int, length: int) -> bytes:
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(length, offset)


def read_archives(spark: SparkSession, folder: str, urls: DataFrame | list[str] | None = None, payloads: bool = True) -> DataFrame:
    """Captures read back through the index: all, or those of ``urls`` (a list, or a table with ``url``).

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and with ``payloads``
    ``payload`` (null for revisits). Each capture comes once, however often its URL is asked for.
    """
    directory = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    if urls is not None:
        asked = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
        directory = blocks_with(spark, folder, asked)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if payloads:
        schema, kinds = f"{schema}, payload binary", [*kinds, pa.binary()]
    fields = pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                found = list(read_block(block, read_range))
                if found:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in fields.names} for r in found], fields)

    return in_arrow(directory.repartition(parts(spark)), run, schema)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(captures(pages), folder)
    # Every page's URL is looked up in the index.
    return read_archives(spark, folder, pages.select("url"), payloads=False)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM k
"""
