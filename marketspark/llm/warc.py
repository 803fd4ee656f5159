"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing: a response record holds an HTTP answer in chunked transfer framing. A
block longer than a segment is cut; the first segment is a ``response`` record,
the rest are ``continuation`` records that name the first as their origin, and the
last gives the total length. Of equal payloads one record is the response, the
others are ``revisit`` records without a payload that refer to it by its record
identifier.

Reading: Spark reads the files, once; records are found by their Content-Length
while the file is inflated. Continuation records are grouped by their origin
identifier and ordered by segment number: where a file holds all segments of a
record one after the other, in the task that reads it, else (a record goes over
the end of a file, or its segments are scattered) by a shuffle of these segments
alone. The total length is verified, and the chunked framing is decoded as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import column_of, materialise, small

END = b"\r\n"
SEPARATOR = "\r\n\r\n"
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    out = bytearray()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += b"%x\r\n" % len(part) + part + END
    return bytes(out + b"0\r\n\r\n")


class ChunkedDecoder:
    """Decodes chunked framing fed in pieces of any size; holds back a size line at most."""

    def __init__(self):
        self.rest, self.left, self.state = b"", 0, "size"

    @property
    def done(self) -> bool:
        return self.state == "done"

    def feed(self, data: bytes) -> bytes:
        out, data = bytearray(), self.rest + data
        self.rest, at = b"", 0
        while at < len(data) and self.state != "done":
            if self.state == "data":
                part = data[at : at + self.left]
                out += part
                at += len(part)
                self.left -= len(part)
                if not self.left:
                    self.state = "after"
                continue
            end = data.find(END, at)
            if end < 0:
                if len(data) - at > 4096:
                    raise ValueError("no end of a chunk's size line")
                self.rest = data[at:]
                break
            line, at = data[at:end], end + 2
            if self.state == "after":
                if line:
                    raise ValueError("a chunk is longer than its size")
                self.state = "size"
            elif self.state == "size":
                self.left = int(line.partition(b";")[0].strip(), 16)
                self.state = "data" if self.left else "trailer"
            elif not line:  # trailer fields end with an empty line
                self.state = "done"
        return bytes(out)


def record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it, which the writer of lines adds."""
    head = VERSION + END + f"WARC-Type: {kind}\r\n".encode()
    for name, value in headers:
        head += f"{name}: {value}\r\n".encode()
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def revisits(df: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(_id, _sha, _refers) of every row whose payload an other row of larger identifier has too."""
    slim = df.select(
        column_of(df, id_col).cast("long").alias("_id"),
        F.coalesce(column_of(df, payload_col).cast("string"), F.lit("")).alias("_p"),
    ).filter(F.octet_length("_p") >= least)
    keys = ["_sha", "_len", "_check"]
    slim = slim.select("_id", F.sha1(F.col("_p").cast("binary")).alias("_sha"), F.octet_length("_p").alias("_len"), F.xxhash64("_p").alias("_check"))
    first = slim.groupBy(*keys).agg(F.max("_id").alias("_refers"), F.count("*").alias("_n")).filter("_n > 1")
    return slim.join(first, keys).filter("_id < _refers").select("_id", "_sha", "_refers").distinct()


def write_warc(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    segment_bytes: int = 64 * 1024,
    least_revisit: int = 1000,
    file_bytes: int = 64 << 20,
) -> None:
    """Writes one logical record per row, as gzipped WARC files under ``path``, by Spark's own writer.

    Null payloads are empty, null urls are left out. Payloads shorter than
    ``least_revisit`` bytes are always responses. A row with a null identifier is
    a response, ``urn:page:null``. Rows that repeat identifier and payload are
    written each, with identifiers of their own. An empty table writes no record.
    A file holds about ``file_bytes`` before compression, however large a payload
    is: no record is longer than a segment, and one that goes over the end of a
    file is continued in the next.
    """
    if segment_bytes < 1:
        raise ValueError("segment_bytes is at least 1")
    rows = df.select(
        column_of(df, id_col).cast("long").alias("_id"),
        column_of(df, url_col).cast("string").alias("_url"),
        F.coalesce(column_of(df, payload_col).cast("string"), F.lit("")).alias("_payload"),
    )
    rows = rows.withColumn("_digest", F.sha1(F.col("_payload").cast("binary")))
    again = revisits(df, id_col, payload_col, least_revisit).hint("merge")
    # rows of one identifier and payload stay together and in order, so that the first of them is known
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.filter("_id is not null").repartition(n, "_id", "_digest")
    joined = named.join(again, (named["_id"] == again["_id"]) & (named["_digest"] == again["_sha"]), "left").select(
        named["_id"], "_url", F.when(F.col("_refers").isNull(), F.col("_payload")).alias("_payload"), "_digest", "_refers"
    )
    joined = joined.sortWithinPartitions("_id", "_digest")
    joined = joined.unionByName(rows.filter("_id is null").withColumn("_refers", F.lit(None).cast("long")))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, last = TaskContext.get().partitionId(), 0, None
        for batch in small(batches):
            out = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                own = page is None or (page, digest) == last  # a further one
                last = (page, digest)
                me = f"<urn:page:{'null' if page is None else page}:{digest}{f':{task}.{n}' if own else ''}>"
                common = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []
                common += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers is not None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    out.append(record("revisit", [("WARC-Record-ID", f"{me[:-1]}:{task}.{n}>"), ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>"), ("WARC-Profile", profile), *common], b""))
                    continue
                block = HTTP + chunked((payload or "").encode())
                last_part = (len(block) - 1) // segment_bytes
                if not last_part:
                    out.append(record("response", [("WARC-Record-ID", me), *common], block))
                for k in range(last_part + 1 if last_part else 0):
                    fields = [("WARC-Record-ID", me if not k else f"{me[:-1]}/{k + 1}>"), ("WARC-Segment-Number", str(k + 1))]
                    if k:
                        fields.append(("WARC-Segment-Origin-ID", me))
                    if k == last_part:
                        fields.append(("WARC-Segment-Total-Length", str(len(block))))
                    out.append(record("continuation" if k else "response", fields if k else fields + common, block[k * segment_bytes : (k + 1) * segment_bytes]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = joined.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    # heads take some hundred bytes
    lines.write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + 512))).text(path)


def inflated(data, size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file, gzipped (in any number of members) or not, piece by piece."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), size):
            yield bytes(view[at : at + size])
        return
    machine, at = zlib.decompressobj(31), 0
    while at < len(view):
        part = view[at : at + size]
        yield machine.decompress(part)
        at += len(part) - len(machine.unused_data)
        if machine.eof:
            machine = zlib.decompressobj(31)
    yield machine.flush()


def parse_records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a file; holds one record at a time."""
    source, held, at, ended = inflated(data), bytearray(), 0, False

    def more() -> bool:
        nonlocal ended
        part = next(source, None)
        ended = part is None
        if part:
            held.extend(part)
        return not ended

    while True:
        while held.startswith(END, at):
            at += 2
        end = held.find(b"\r\n\r\n", at)
        if end < 0:
            if more():
                continue
            if bytes(held[at:]).strip(END):
                raise ValueError("a file ends within a record's head")
            return
        if not held.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should begin")
        headers = {}
        for line in bytes(held[at:end]).split(END)[1:]:
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        while stop > len(held):
            if not more():
                raise ValueError("a record is cut off")
        yield headers, bytes(held[start:stop])
        at = stop
        if at > 1 << 20:
            del held[:at]
            at = 0


WHOLE = "record_id string, record_type string, uri string, refers string, payload_bytes long, payload_digest string, verified boolean, payload binary"
#: A record that is put together has no number; a segment has one, its block as payload and, if it is the last, the total.
SCANNED = f"{WHOLE}, number long, total long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCANNED = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in SCANNED.split(", ")])
_WHOLE = pa.schema(list(_SCANNED)[:8])


class _Answer:
    """One record being put together: the HTTP head is dropped, the body decoded, counted and hashed."""

    def __init__(self, origin, kind, uri, digest, refers, keep: bool):
        self.origin, self.kind, self.uri, self.digest, self.refers, self.keep = origin, kind, uri, digest, refers, keep
        self.head, self.decoder, self.chunks = b"", None, None
        self.length = self.bytes = 0
        self.next = 1
        self.sha, self.parts, self.good = hashlib.sha1(), [], True

    def feed(self, block: bytes) -> None:
        self.length += len(block)
        if self.chunks is None:
            self.head += block
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            fields = self.head[:end].lower().split(END)
            self.chunks = any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields)
            self.decoder = ChunkedDecoder() if self.chunks else None
            block, self.head = self.head[end + 4 :], b""
        if self.chunks:
            try:
                block = self.decoder.feed(block)
            except ValueError:
                self.good = False
                return
        self.bytes += len(block)
        self.sha.update(block)
        if self.keep:
            self.parts.append(block)

    def row(self, total: int | None) -> tuple:
        if self.kind == "revisit":
            return self.origin, self.kind, self.uri, self.refers, None, self.digest, True, None
        good = self.good and (total is None or total == self.length) and (self.decoder is None or self.decoder.done)
        found = self.sha.hexdigest()
        good = good and (self.digest is None or self.digest == found)
        return self.origin, self.kind, self.uri, self.refers, self.bytes, found, good, b"".join(self.parts) if self.keep else None


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Sewer:
    """Takes a file's records in order; gives rows of SCANNED."""

    def __init__(self, payloads: bool, most_bytes: int):
        self.payloads, self.most_bytes = payloads, most_bytes
        self.parts: list[tuple] = []
        self.held = 0

    def loose(self) -> list[tuple]:
        out = [(origin, kind, uri, refers, None, digest, None, block, number, total) for origin, kind, number, total, uri, digest, refers, block in self.parts]
        self.parts, self.held = [], 0
        return out

    def take(self, headers: dict[str, str], block: bytes) -> list[tuple]:
        kind, number = headers["warc-type"], headers.get("warc-segment-number")
        if kind not in ("response", "revisit", "continuation"):
            return []
        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        origin, uri, refers = headers.get("warc-segment-origin-id") or headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to")
        if number is None:
            answer = _Answer(origin, kind, uri, digest, refers, self.payloads)
            answer.feed(block)
            return [(*answer.row(None), None, None)]
        number, total = int(number), headers.get("warc-segment-total-length")
        out = []
        if self.parts and (origin != self.parts[0][0] or number != self.parts[-1][2] + 1 or self.held > self.most_bytes):
            out = self.loose()
        self.parts.append((origin, kind, number, int(total) if total else None, uri, digest, refers, block))
        self.held += len(block)
        if self.parts[0][2] != 1:
            return out + self.loose()
        if total:
            answer = _Answer(origin, "response", *(self.parts[0][i] for i in (4, 5, 6)), self.payloads)
            for part in self.parts:
                answer.feed(part[-1])
            out.append((*answer.row(int(total)), None, None))
            self.parts, self.held = [], 0
        return out


def read_warc(spark: SparkSession, path: str, payloads: bool = True, most_bytes: int = 16 << 20) -> DataFrame:
    """One row per logical record: record_id, record_type, uri, refers, payload_bytes, payload_digest, verified, payload.

    ``payload_bytes`` and ``payload_digest`` (bare hex SHA-1) are of the decoded
    payload; a revisit has no bytes of its own and the digest it names.
    ``verified``: total length, segment numbers, framing and digest are all right.
    Without ``payloads`` the payload is counted and hashed but not kept. Segments
    of more than ``most_bytes`` together are put together behind the shuffle, where
    they pass one by one, so a record of any length needs no more memory than that.
    Other kinds of records are passed over; a folder without records gives no rows;
    repeated records are rows each unless they are segmented, which the second of
    them makes unverified. A file that isn't WARC is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                sewer, out, held = _Sewer(payloads, most_bytes), [], 0
                for headers, block in parse_records(content.as_buffer()):
                    out += sewer.take(headers, block)
                    held += len(block)
                    if held > 4_000_000 and out:
                        yield _rows(out, _SCANNED)
                        out, held = [], 0
                out += sewer.loose()
                if out:
                    yield _rows(out, _SCANNED)

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, total, out, held = None, None, [], 0
        for batch in small(batches):
            for origin, kind, uri, refers, digest, block, number, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if answer is None or answer.origin != origin:
                    if answer is not None:
                        out.append(answer.row(-1 if total is None else total))
                    answer, total = _Answer(origin, "response", uri, digest, refers, payloads), None
                answer.good = answer.good and number == answer.next and (kind == "response") == (number == 1)
                answer.next = number + 1
                answer.feed(block)
                total = length if length is not None else total
                held += len(block)
            if held > 4_000_000 and out:
                yield _rows(out, _WHOLE)
                out, held = [], 0
        if answer is not None:
            out.append(answer.row(-1 if total is None else total))
        if out:
            yield _rows(out, _WHOLE)

    scanned = materialise(files.mapInArrow(scan, SCANNED), "warc-records")
    loose = scanned.filter("number is not null").select("record_id", "record_type", "uri", "refers", "payload_digest", "payload", "number", "total")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sewn = loose.repartition(n, "record_id").sortWithinPartitions("record_id", "number").mapInArrow(together, WHOLE)
    return scanned.filter("number is null").select(_WHOLE.names).unionByName(sewn)


def archive_round_trip(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Writes ``df`` to ``path`` and reads it back; per row: id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A revisit's bytes are those of the response it refers to, looked up in the
    archive by its record identifier. Same cases as ``write_warc``.
    """
    write_warc(df, path, id_col, url_col, payload_col, **options)
    found = read_warc(df.sparkSession, path, payloads=False).drop("payload")
    id_of = lambda name: F.split(name, "[:>]")[2].try_cast("long")
    answers = found.filter("record_type = 'response'").select(F.col("record_id").alias("_response"), F.col("payload_bytes").alias("_bytes"))
    plain = found.filter("record_type <> 'revisit'").withColumn("_bytes", F.col("payload_bytes"))
    back = found.filter("record_type = 'revisit'").join(answers, F.col("refers") == F.col("_response"), "left").drop("_response")
    return plain.unionByName(back.select(plain.columns)).select(
        id_of("record_id").alias(id_col),
        F.col("_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        id_of("refers").alias("refers_to"),
        (F.col("verified") & F.col("_bytes").isNotNull()).alias("verified"),
    )
