"""Deterministic sharded WARC archives.

Pages are range-sorted by ``page_id``; every partition writes its records in that order into gzip members and rolls to
the next file when the compressed size passes a limit. Record headers, lengths and SHA-256 digests are generated anew;
record ids and dates depend on the data only, so equal input gives equal records. Of pages with equal payloads of at
least ``LEAST`` bytes, the one with the smallest id is a response record and the others are revisit records that name
it. Only ids and digests are shuffled to find them; payloads move once, to be sorted.

Files get temporary names and are moved to their final ones when complete. The manifest (Parquet, one row per file) is
written last, and only files it lists count, so a lost task leaves nothing a reader would see.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import new_folder, publish, store, table

LEAST = 100
ROLL_BYTES = 256 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE = "application/http; msgtype=response"

PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, whoever writes it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header_value(text: str) -> str:
    """A URL as it may stand in a header: blanks, controls and other than ASCII percent-encoded."""
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~_.-")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record. A revisit (``first`` is the page it refers to) keeps the HTTP header and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += [f"Content-Type: {TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes records into ``part-P-N.warc.gz`` files of about ``limit`` compressed bytes."""

    def __init__(self, folder: str, part: int, attempt: int, limit: int):
        self.files, self.root = store(folder)
        self.part, self.attempt, self.limit, self.done, self.sink = part, attempt, limit, [], None

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.part:05d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{self.attempt}"
            self.sink = self.files.open_output_stream(self.temporary)
            self.size, self.records, self.first = 0, 0, page_id
        member = gzip.compress(raw, LEVEL, mtime=0)
        self.sink.write(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            publish(self.files, self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.first, self.last))
            self.sink = None


MANIFEST = "file string, n_records long, n_bytes long, first_page long, last_page long"


def write_archives(pages: DataFrame, folder: str, limit: int = ROLL_BYTES, least: int = LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files into ``folder`` and return the manifest.

    NULL html is an empty payload, a NULL url a record without target. NULL ids come first and are never referred to;
    among equal payloads without any id all are responses. Rows that repeat the id of the response are responses, too.
    Other columns are ignored. An empty table writes an empty manifest.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long"), "url", body.alias("body"))
    digests = narrow.where(F.octet_length("body") >= least).select("page_id", F.sha2("body", 256).alias("digest"))
    shared = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = digests.join(shared, "digest").where("page_id > first OR page_id IS NULL AND first IS NOT NULL")
    # a note (kind 0) sorts right before the pages it belongs to
    notes = revisits.select("page_id", F.lit(0).alias("kind"), "digest", "first").distinct()
    both = notes.select("page_id", "kind", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body")).unionByName(
        narrow.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"), "url", "body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, at, known = TaskContext.get(), object(), {}
        roller = Roller(folder, context.partitionId(), context.taskAttemptId(), limit)
        for batch in batches:
            ids, kinds, digest, first, url = (batch.column(i).to_pylist() for i in range(5))
            for i, page_id in enumerate(ids):
                if page_id != at:
                    at, known = page_id, {}
                if not kinds[i]:
                    known[digest[i]] = first[i]
                    continue
                payload = batch.column(5)[i].as_py()
                own = hashlib.sha256(payload).hexdigest()
                roller.add(page_id, record(page_id, url[i], payload, own, known.get(own)))
        roller.close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in roller.done], type=kind) for i, kind in enumerate(kinds)], names=names
        )

    files, root = store(folder)
    files.create_dir(root, recursive=True)
    ranged = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", F.xxhash64("body"), "url")
    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


_SPLIT = re.compile(r":\s*")


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("ascii").split("\r\n")[1:]
    return {name.lower(): value for name, value in (_SPLIT.split(line, maxsplit=1) for line in lines if line)}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC headers, HTTP header, payload) of every record of an open archive; lengths and digests are verified."""
    with gzip.GzipFile(fileobj=source) as archive:
        while line := archive.readline():
            head = line
            while (line := archive.readline()) != b"\r\n":
                if not line:
                    raise ValueError("an archive ends within a header")
                head += line
            headers = parse_headers(head)
            block = archive.read(int(headers["content-length"]))
            if archive.read(4) != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
                raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
            http, _, payload = block.partition(b"\r\n\r\n")
            yield headers, http, payload


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files the manifest lists: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def page(headers: dict[str, str], http: bytes, payload: bytes) -> tuple:
        digest, n = headers["warc-payload-digest"].removeprefix("sha256:"), int(parse_headers(http)["content-length"])
        kind = headers["warc-type"]
        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        ids = [int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page-id")]
        return ids[0], n, digest, kind, ids[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for found in read_records(source):
                        rows.append(page(*found))
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    tasks = manifest.select("file").repartitionByRange(4 * manifest.sparkSession.sparkContext.defaultParallelism, "file")
    return tasks.mapInArrow(run, PAGE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


ORACLE = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
