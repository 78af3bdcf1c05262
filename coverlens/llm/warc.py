"""WARC archives of pages, and one globally ordered index of all captures merged from the archives' own.

Each task sorts its captures by URL key and time and writes them to an archive of its own, so that the archive's index
is a sorted run. The runs are cut at common URL keys; each range merges its piece of every run with a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm.common import numbered, small_batches
from coverlens.llm.files import opened
from coverlens.llm.urls import host_of, path_of
from coverlens.session import shared_path, stored

# Smaller payloads are stored again each time.
LEAST_BYTES = 100
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
INDEX = "page_id long, url string, url_key string, captured long, archive string, start long, size long, run long"
READ = "archive string, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _when(second: int) -> str:
    return (EPOCH + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record_id(page: int | None) -> str:
    """The same page always has the same record id; several captures of a page share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def record(page: int | None, url: str | None, second: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed by itself. A revisit leaves out the payload and names the page that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = (url or "about:blank").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + _record_id(page).encode(),
        b"WARC-Date: " + _when(second).encode(),
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha256:" + base64.b32encode(bytes.fromhex(digest)),
        b"WARC-Block-Digest: sha256:" + base64.b32encode(hashlib.sha256(block).digest()),
        b"Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        head.append(b"X-Page-ID: %d" % page)
    if refers_to is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + _record_id(refers_to).encode(),
            b"X-Refers-To-Page: %d" % refers_to,
        ]
    head.append(b"Content-Length: %d" % len(block))
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with url_key, captured (seconds), digest and refers_to.

    Of equal payloads of at least 100 bytes the smallest page_id is stored; others refer to it. Only digests are grouped.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    big = rows.where(F.octet_length(payload) >= LEAST_BYTES)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1 AND first IS NOT NULL")
    first = stored(first.select(F.col("digest").alias("of"), "first"), "first-captures")
    joined = rows.join(first, F.col("digest") == F.col("of"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    host = F.array_join(F.reverse(F.split(host_of(F.col("url")), r"\.")), ",")
    key = F.concat(host, F.lit(")"), path_of(F.col("url")))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"), key.alias("url_key"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)).alias("captured"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task below ``folder`` and returns the captures' index: each archive is a sorted run.

    A task that is repeated writes another file; only files that the returned, written index names count.
    """
    plan = planned(pages).sortWithinPartitions("url_key", "captured", "page_id")

    def write(batches):
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        run, at, sink = uuid.uuid4().int >> 65, 0, None
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    sink = sink or files.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(row["page_id"], row["url"], row["captured"], (row["html"] or "").encode(), row["digest"], row["refers_to"])
                    sink.write(data)
                    index.append((row["page_id"], row["url"], row["url_key"], row["captured"], f"{folder}/{name}", at, len(data), run))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), _INDEX_TYPES)], _INDEX_NAMES) if index else _no_index()
        finally:
            if sink:
                sink.close()

    return stored(plan.mapInArrow(write, INDEX), "runs")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]


def _no_index() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _INDEX_TYPES], _INDEX_NAMES)


class LoserTree:
    """Merges sorted lists: an inner node keeps the loser of its match, the root the winner. One path is replayed per row."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.place = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _head(self, i: int):
        """The run's next key; a used-up run loses against all."""
        return (0, self.key(self.runs[i][self.place[i]]), i) if self.place[i] < len(self.runs[i]) else (1, (), i)

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self.heads[other] < self.heads[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.losers[0]
            if self.heads[i][0]:
                return
            yield self.runs[i][self.place[i]]
            self.place[i] += 1
            self.heads[i] = self._head(i)
            self._replay(i)


def _order(row: dict):
    """By URL key in byte order, then time, then page; a missing page first."""
    return row["url_key"].encode(), row["captured"], row["page_id"] is not None, row["page_id"] or 0


def merged_index(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """All captures in order of (url_key, captured, page_id), with ``position``, gapless from 0 over the whole index.

    Every task gets one range of keys, of about ``range_rows`` rows, and with it a piece of each run; the last parts of the
    order are time and page, so the captures of one URL may span several ranges. Rows that tie keep the order of their runs.
    """

    def merge(batches):
        pieces: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pieces.setdefault(row["run"], []).append(row)
        merged = []
        for row in LoserTree([pieces[r] for r in sorted(pieces)], _order):
            merged.append(row)
            if len(merged) == 5000:
                yield _rows(merged)
                merged = []
        if merged:
            yield _rows(merged)

    count = runs.count()
    ranges = runs.repartitionByRange(max(1, -(-count // range_rows)), "url_key", "captured", "page_id")
    # A run's piece arrives in many shuffle blocks; within the task it is put together in the run's own order.
    return positions(ranges.sortWithinPartitions("run", "start").mapInArrow(merge, INDEX))


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_INDEX_NAMES, _INDEX_TYPES)], _INDEX_NAMES)


def positions(ordered: DataFrame) -> DataFrame:
    """Numbers rows in the order of partitions and of rows within them; the order is not made anew."""
    return numbered(ordered, name="position")


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = dict((k.strip().lower().decode(), v.strip().decode()) for k, _, v in (x.partition(b":") for x in lines[1:]))
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def records(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Start, headers and block of every record of an archive that is open for reading."""
    start, come, left = 0, 0, b""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = left
        if not data:
            data = source.read(1 << 16)
            come += len(data)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpack.decompress(data))
        left = b""
        if unpack.eof:
            left = unpack.unused_data
            yield start, *read_record(b"".join(parts))
            start, unpack, parts = come - len(left), zlib.decompressobj(31), []


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Reads the archives that the index names, each once and as a whole, and checks every digest on the way.

    Bytes and digest of a response come from its payload. Those of a revisit come from the response that it refers to.
    """

    def read(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, path = opened(archive)
                rows = []
                with files.open_input_stream(path, compression=None) as source:
                    for start, headers, block in records(source):
                        if hashlib.sha256(block).digest() != base64.b32decode(headers["warc-block-digest"].removeprefix("sha256:")):
                            raise ValueError(f"{archive}: a block's digest is wrong at {start}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        kind = headers["warc-type"]
                        own = kind == "response"
                        rows.append(
                            (
                                archive, start, _number(headers.get("x-page-id")), len(payload) if own else None,
                                hashlib.sha256(payload).hexdigest() if own else base64.b32decode(headers["warc-payload-digest"].removeprefix("sha256:")).hex(),
                                kind, _number(headers.get("x-refers-to-page")),
                            )
                        )
                        if len(rows) == 5000:
                            yield _read_rows(rows)
                            rows = []
                if rows:
                    yield _read_rows(rows)

    # A number of partitions that is asked for is not coalesced, though a list of names is small.
    archives = stored(index.select("archive").distinct(), "archive-names")
    archives = archives.repartition(max(1, archives.count()))
    found = stored(archives.mapInArrow(read, READ), "records")
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("stored_bytes"))
    sizes = stored(sizes.select(F.col("payload_digest").alias("of"), "stored_bytes"), "payload-sizes")
    joined = found.join(sizes, F.col("payload_digest") == F.col("of"), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "stored_bytes")).drop("of", "stored_bytes")


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


_READ_NAMES = [x.split()[0] for x in READ.split(", ")]
_READ_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_TYPES)], _READ_NAMES)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives, merges their indexes, reads the archives back.

    Returns a row per page: page_id, url_key, captured, position (in the merged index), archive, start, payload_bytes,
    payload_digest, record_type, refers_to. A null html is an empty payload, a null url is archived as about:blank.
    Repeated rows are each archived: of equal payloads every row with the smallest page_id is a response. A page
    without id is a revisit of a stored payload and else a response. Other columns are ignored. An empty input gives no rows.
    The archives stay in ``folder`` (by default below the shared folder).
    """
    spark = small_batches(pages).sparkSession
    folder = folder or shared_path(spark, "archives")
    index = merged_index(write_archives(pages.select("page_id", "url", "html"), folder))
    index = stored(index.select(F.col("archive").alias("in"), F.col("start").alias("at"), "url_key", "captured", "position"), "index")
    read = read_archives(spark, index.select(F.col("in").alias("archive")))
    joined = read.join(index, (F.col("archive") == F.col("in")) & (F.col("start") == F.col("at")))
    return joined.drop("in", "at")
