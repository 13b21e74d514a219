"""WARC archives with Zstandard: written and read through Spark's own file sources.

An archive begins with a skippable frame (magic ``5D 2A 4D 18``) that holds the dictionary; then
comes one frame per record. Archives are written by Spark's text sink, one file per task, a frame
per row; its row separator is set to the eight bytes of an empty skippable frame, so a file is a
plain sequence of frames. They are read as binary files: frames are walked block by block, each is
decoded with the archive's dictionary, and version, fields, lengths and digests are validated.

The dictionary is trained on at most ``SAMPLE`` payloads (smallest hashes of ``page_id``), of
``SAMPLE_BYTES`` bytes each; it changes the size of the archives, never a result.

Defined results: a null html is an empty payload; of equal payloads of at least ``REVISIT_BYTES``
the smallest ``page_id`` is the response and all rows with that id are, others revisit it; rows
without ``page_id`` revisit a row with one and are responses otherwise; a null url leaves out the
target field; line ends in a url are percent-encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import hash_key, written
from burnish.plans.materialize import shared_folder
from burnish.plans.shipping import ship

REVISIT_BYTES = 100
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
#: Pages of about this many bytes go into an archive, which is read as a whole.
ARCHIVE_BYTES = 32 << 20

# Fixed values of the formats.
_DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
_FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
_EMPTY_FRAME = b"P*M\x18\0\0\0\0"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RESULT = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, fault string"
)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add ``payload, payload_bytes, digest, refers_to``; the last is null for responses.

    Only digests that occur more than once are joined back, so a third of equal payloads is one
    small row on one side and split by adaptive execution on the other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                       payload.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    several = (
        own.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null").select("digest", "first")
    )
    joined = own.join(written(several, "repeated"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def train_dictionary(pages: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample, empty if there is too little text."""
    some = pages.where("html is not null and html != ''").withColumn(
        "__key", hash_key(F.lit("warc"), F.col("page_id"), F.col("url"))
    )
    keys = some.select("__key").orderBy("__key").limit(SAMPLE).collect()
    if not keys:
        return b""
    chosen = some.where(F.col("__key") <= keys[-1][0])
    rows = chosen.select(F.substring("html", 1, SAMPLE_BYTES).alias("part")).limit(SAMPLE).collect()
    parts = sorted(r["part"].encode()[:SAMPLE_BYTES] for r in rows)
    if sum(map(len, parts)) < 10 * DICTIONARY_BYTES or len(parts) < 20:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit holds the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
           f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        fields.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record per page into archives under ``folder``."""
    spark = pages.sparkSession
    ship(spark)
    trained = spark.sparkContext.broadcast(train_dictionary(pages))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = trained.value
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        room = 0
        for batch in batches:
            columns = [batch.column(c) for c in
                       ("page_id", "url", "payload", "digest", "refers_to")]
            for at in range(0, batch.num_rows, 256):
                rows = zip(*[c.slice(at, 256).to_pylist() for c in columns])
                out = [tool.compress(record(*r)) for r in rows]
                if not room:
                    out[0] = _DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw + out[0]
                    room = 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = with_revisits(pages)
    total = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    if total > ARCHIVE_BYTES:  # else no task can hold more; dealt in turn, whatever repeats
        rows = rows.repartition(-(-total // ARCHIVE_BYTES))
    rows = rows.mapInArrow(frames, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", _EMPTY_FRAME.decode("latin-1")
    ).text(folder)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends."""
    head = data[at + 4]
    sizes = (0, 1, 2, 4)[head & 3] + (1 if head & 32 and not head >> 6 else
                                      (0, 2, 4, 8)[head >> 6])
    at += 5 + (0 if head & 32 else 1) + sizes
    while True:
        word = int.from_bytes(data[at:at + 3], "little")
        if at + 3 > len(data) or (word >> 1) & 3 == 3:
            raise ValueError("damaged block")
        at += 3 + (1 if (word >> 1) & 3 == 1 else word >> 3)
        if word & 1:
            return at + (4 if head & 4 else 0)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded records of one archive."""
    data = memoryview(content)
    if bytes(data[:4]) != _DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    size = int.from_bytes(data[4:8], "little")
    raw = bytes(data[8:8 + size])
    if raw[:4] == _FRAME_MAGIC:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
        elif magic == 0xFD2FB528:
            end = _frame_end(data, at)
            yield tool.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(raw: bytes) -> tuple:
    """The fields of ``_RESULT`` from one record; the last tells what is wrong with it."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def number(name: str | None) -> int | None:
        name = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name.lstrip("-").isdigit() else None

    page_id, kind = number(fields.get("warc-record-id")), fields.get("warc-type")
    url = fields.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    refers, fault, size, payload = number(fields.get("warc-refers-to")), None, None, None
    length = fields.get("content-length", "")
    if not found or lines[0] != "WARC/1.1":
        fault = "version"
    elif not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= fields.keys():
        fault = "missing field"
    elif not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        fault = "record length"
    else:
        http, found, body = rest[:-4].partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:]
                 if x.lower().startswith(b"content-length:")]
        if not found or not sizes or not sizes[0].isdigit():
            fault = "block head"
        else:
            size = int(sizes[0])
            if kind == "response":
                payload = body
                if len(body) != size:
                    fault = "payload length"
                elif hashlib.sha256(body).hexdigest() != digest:
                    fault = "payload digest"
            elif body:
                fault = "revisit with payload"
    return page_id, url, size, digest, kind, refers, payload, fault


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives under ``folder``; ``fault`` is null for sound records."""
    ship(spark)
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary()), ("fault", pa.string())])
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for raw in frames(content.as_buffer()):
                    row = parse(raw)
                    rows.append(row if payloads else (*row[:6], None, row[7]))
                    if len(rows) == 256:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(records, _RESULT).select(*names)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to new archives in the shared folder and read these."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, payloads=False)
