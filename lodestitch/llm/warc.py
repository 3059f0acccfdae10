"""WARC archives as a chunked record table.

Writing: a payload is cut into segments of bounded size, each a WARC record of its own
(``response`` and its ``continuation`` records, with segment numbers, origin and total
length), so a row never grows beyond a segment. Spark's text sink writes them with CRLF as
line end, gzip-compressed, to any file system that Spark reaches. Archives are bounded in
size: every ``RUN`` segments of a payload are dealt anew, so a payload of any length is spread
over many archives and none holds it whole. Copies of a payload of at least ``least`` bytes are
written once; the others become ``revisit`` records that refer to it.

Reading: each archive streams through an incremental decompressor and parser, which yields
rows (record identifier, chunk number) with at most ``chunk_bytes`` of payload, the bytes so
far and, where the record began in this archive, the running SHA-1. Rows of an oversized
(segmented) record carry their bytes: they are shuffled by record, sorted by chunk number and
streamed through an incremental digest, a few chunks at a time; what fits in one segment has
its digest already and sends none. Digests are checked against the record headers. No
record is ever held whole.

Defined results: null payloads are empty; a null page_id is written as such and loses to any
other as keeper of a payload; rows that share page and payload with the keeper are all
responses; repeated rows are records of their own; an empty table gives archives without
records; control characters in URLs are percent-encoded; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CRLF = "\r\n"
SEGMENT_BYTES = 1 << 18
CHUNK_BYTES = 1 << 16
#: Segments of a payload that one task writes, to one archive unless that is full.
RUN = 16
#: Chunk numbers of a segment start at its number, from 0, times this.
SEGMENT_CHUNKS = 1 << 20
#: Chunk rows of an oversized record that a task holds at a time.
HELD_CHUNKS = 64
#: Payload bytes that an archive should hold, before compression.
ARCHIVE_BYTES = 24 << 20
#: Tasks that write at most; beyond so many archives each task writes several, one after the other.
MOST_TASKS = 20_000
REVISIT_LEAST = 1000
#: Record date and revisit profile, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
CONTROLS = [*range(32), 127]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def encoded_url(url: Column) -> Column:
    """Control characters, which would break a header, as percent and code."""
    out = url
    for code in CONTROLS:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def plan_records(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, uid, url, payload, digest, bytes and refers_to (null for responses)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", F.monotonically_increasing_id().alias("uid"), "url", payload.alias("payload")).select(
        "page_id", "uid", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")
    )
    keepers = (
        pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
        .where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "keeper")
    )
    keepers = shared.maybe_broadcast(shared.materialize(keepers, "keepers"), 200_000)
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return base.join(keepers, "digest", "left").withColumn("refers_to", F.when(other, F.col("keeper"))).drop("keeper")


def _segments(records: DataFrame, segment_bytes: int) -> DataFrame:
    """One row per segment: part number, parts, and its bytes; revisits have one empty part."""
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    parts = F.greatest(F.ceil(F.octet_length("kept") / segment_bytes), F.lit(1)).cast("int")
    return (
        records.withColumn("kept", kept)
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        .withColumn("block", F.substring(F.col("kept"), (F.col("part") - 1) * segment_bytes + 1, F.lit(segment_bytes)))
        .drop("kept", "payload")
    )


def _render(segments: DataFrame) -> DataFrame:
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    name = F.concat(F.lit("urn:page:"), page, F.lit(":"), F.col("uid"))
    first, cut, revisit = F.col("part") == 1, F.col("parts") > 1, F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").when(first, "response").otherwise("continuation"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        _field("WARC-Record-ID", F.concat(F.lit("<"), name, F.when(first, F.lit("")).otherwise(F.concat(F.lit(":"), F.col("part"))), F.lit(">"))),
        _field("WARC-Target-URI", F.when(first, encoded_url(F.col("url")))),
        _field("WARC-Page-ID", F.when(first, F.col("page_id"))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To-Page", F.col("refers_to")),
        _field("WARC-Segment-Number", F.when(cut, F.col("part"))),
        _field("WARC-Segment-Origin-ID", F.when(cut & ~first, F.concat(F.lit("<"), name, F.lit(">")))),
        _field("WARC-Segment-Total-Length", F.when(cut & (F.col("part") == F.col("parts")), F.col("bytes"))),
        _field("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
    )
    # The sink adds the second CRLF that ends a record.
    return segments.select(F.concat(head.cast("binary"), F.col("block"), F.lit(CRLF).cast("binary")).cast("string").alias("value"))


def write_archives(
    pages: DataFrame, path: str, *, least: int = REVISIT_LEAST, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a WARC record per page to gzip archives under ``path``. Their number grows with the table, that of the
    tasks only up to ``MOST_TASKS``: a task begins a new archive after so many records as fill one on average."""
    rows, total = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    archives = max(1, -(-total // archive_bytes))
    each = -(-(rows + total // segment_bytes + 1) // archives)
    segments = _segments(plan_records(pages, least), segment_bytes)
    run = F.floor((F.col("part") - 1) / RUN)
    dealt = segments.repartition(min(archives, MOST_TASKS), "uid", run).sortWithinPartitions("page_id", "uid", "part")
    rolled = _render(dealt).write.option("maxRecordsPerFile", each if archives > MOST_TASKS else 0)
    rolled.option("lineSep", CRLF).option("compression", "gzip").text(path)


class _Input:
    """Bytes of an archive, decompressed piece by piece; gzip members may follow each other."""

    def __init__(self, content: bytes, piece: int = 1 << 16):
        self.raw, self.at, self.piece, self.have = memoryview(content), 0, piece, bytearray()
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        if not self.packed:
            took = self.raw[self.at : self.at + self.piece]
            self.at += len(took)
            self.have += took
            return bool(took)
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                if not rest and self.at >= len(self.raw):
                    return False
                self.inflate, feed = zlib.decompressobj(31), rest
                if not feed:
                    feed = self.raw[self.at : self.at + self.piece]
                    self.at += len(feed)
            elif self.inflate.unconsumed_tail:
                feed = self.inflate.unconsumed_tail
            else:
                feed = self.raw[self.at : self.at + self.piece]
                self.at += len(feed)
                if not feed:
                    raise ValueError("archive ends within a gzip member")
            got = self.inflate.decompress(feed, 4 * self.piece)
            if got:
                self.have += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is passed; None at the end of the archive."""
        start = 0
        while (end := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                if self.have.strip():
                    raise ValueError("archive ends within a header")
                return None
        out = bytes(self.have[:end])
        del self.have[: end + len(mark)]
        return out

    def pieces(self, n: int, most: int) -> Iterator[bytes]:
        while n:
            while not self.have:
                if not self.more():
                    raise ValueError("archive ends within a record")
            out = bytes(self.have[: min(n, most)])
            del self.have[: len(out)]
            n -= len(out)
            yield out


def read_records(content: bytes, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of an archive: the record's identifier and headers (None where it began
    elsewhere), chunk number, data, bytes and SHA-1 so far (None likewise), last, whole."""
    source = _Input(content)
    at: dict = {}
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        number = int(fields.get("warc-segment-number", 1))
        if fields["warc-type"] == "continuation":
            name = fields["warc-segment-origin-id"]
            if at.get("name") != name or at["number"] != number - 1:
                at = {"name": name, "fields": None, "sha1": None, "bytes": None}
        else:
            at = {"name": fields["warc-record-id"], "fields": fields, "sha1": hashlib.sha1(), "bytes": 0}
        at["number"] = number
        left = length = int(fields["content-length"])
        ends = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
        for i, data in enumerate(source.pieces(length, chunk_bytes) if length else [b""]):
            left -= len(data)
            if at["sha1"]:
                at["sha1"].update(data)
                at["bytes"] += len(data)
            yield {
                "name": at["name"].strip("<>"), "fields": at["fields"], "segmented": "warc-segment-number" in fields, "chunk": (number - 1) * SEGMENT_CHUNKS + i,
                "data": data, "bytes": at["bytes"], "sha1": at["sha1"] and at["sha1"].hexdigest(), "last": ends and not left,
            }
        if source.until(b"\r\n\r\n") is None:
            raise ValueError("record without its end")


CHUNK_SCHEMA = (
    "record_id string, chunk_no long, page_id long, record_type string, url string, refers_to long, "
    "declared_digest string, segmented boolean, data binary, chunk_bytes long, bytes_so_far long, sha1_so_far string, last boolean"
)
_CHUNK_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
]


def read_chunks(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES, oversized_only: bool = False) -> DataFrame:
    """The chunked record table of the archives under ``path`` (``CHUNK_SCHEMA``). Headers stand on
    rows whose record began in the same archive. With ``oversized_only`` only rows of segmented
    records carry their data."""

    def rows(contents: Iterable[bytes]) -> Iterator[tuple]:
        number = lambda x: int(x) if x is not None else None
        for content in contents:
            for r in read_records(content, chunk_bytes):
                f = r["fields"] or {}
                yield (
                    r["name"], r["chunk"], number(f.get("warc-page-id")), f.get("warc-type"), f.get("warc-target-uri"), number(f.get("warc-refers-to-page")),
                    f.get("warc-payload-digest", "")[5:] or None, r["segmented"], r["data"] if r["segmented"] or not oversized_only else None,
                    len(r["data"]), r["bytes"], r["sha1"], r["last"],
                )

    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), _CHUNK_TYPES)], names=names)

    def run(batches):
        part: list[tuple] = []
        held = 0
        for r in rows(x.as_py() for b in batches for x in b.column("content")):
            part.append(r)
            held += r[8] is not None
            if held >= HELD_CHUNKS or len(part) >= 4096:
                yield batch(part)
                part, held = [], 0
        if part:
            yield batch(part)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, CHUNK_SCHEMA)


def _digests(batches):
    """Whole length and SHA-1 of each record, from chunk rows in order."""
    name, sha1, size, ended = None, None, 0, False
    for batch in batches:
        out = []
        for record, data, last in zip(*(batch.column(c) for c in ("record_id", "data", "last"))):
            if record.as_py() != name:
                if name is not None:
                    out.append((name, size, sha1.hexdigest(), ended))
                name, sha1, size = record.as_py(), hashlib.sha1(), 0
            sha1.update(data.as_buffer())
            size, ended = size + len(data.as_buffer()), last.as_py()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["record_id", "bytes", "sha1", "complete"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, size, sha1.hexdigest(), ended)], names=["record_id", "bytes", "sha1", "complete"])


def read_whole(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written row per record of the archives: record_id, page_id, record_type, url, refers_to,
    declared_digest, and bytes and sha1 of the whole payload as it was read."""
    chunks = read_chunks(spark, path, chunk_bytes=chunk_bytes, oversized_only=True)
    chunks = shared.materialize(chunks, "chunks")
    headers = ["page_id", "record_type", "url", "refers_to", "declared_digest"]
    short = chunks.where("not segmented").groupBy("record_id").agg(
        F.max_by(F.struct(*headers, F.col("bytes_so_far").alias("bytes"), F.col("sha1_so_far").alias("sha1"), F.col("last").alias("complete")), "chunk_no").alias("r")
    )
    oversized = chunks.where("segmented").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    key, held = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(HELD_CHUNKS))
    try:
        sums = shared.materialize(oversized.select("record_id", "data", "last").mapInArrow(_digests, "record_id string, bytes long, sha1 string, complete boolean"), "oversized")
    finally:
        spark.conf.set(key, held)
    first = chunks.where("segmented and chunk_no = 0").select("record_id", *headers)
    records = short.select("record_id", "r.*").unionByName(first.join(sums, "record_id", "full"))
    sound = F.col("complete") & (F.col("record_type").isNotNull()) & ((F.col("record_type") != "response") | (F.col("sha1") == F.coalesce("declared_digest", "sha1")))
    damaged = F.concat(F.lit("record is cut off or its digest differs: "), F.col("record_id"))
    return shared.materialize(records.withColumn("sha1", F.when(F.coalesce(sound, F.lit(False)), F.col("sha1")).otherwise(F.raise_error(damaged))).drop("complete"), "records")


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, and url. A revisit takes length and digest from its response."""
    spark = pages.sparkSession
    path = path or shared.fresh_path(spark, "warc")
    write_archives(pages, path, **options)
    records = read_whole(spark, path)
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    targets = revisits.select(F.col("refers_to").alias("page_id"), F.col("declared_digest").alias("sha1")).distinct()
    full = responses.join(targets, ["page_id", "sha1"], "left_semi").select(F.col("page_id").alias("target"), "sha1", "bytes").distinct()
    again = revisits.select("page_id", "refers_to", "declared_digest", "record_type", "url").join(
        full, (F.col("refers_to") == F.col("target")) & (F.col("declared_digest") == F.col("sha1"))
    )
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "url"]
    return responses.select(*columns).unionByName(again.select(*columns))
