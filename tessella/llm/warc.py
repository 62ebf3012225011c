"""WARC archives, index first.

Writing: every task writes its rows as gzip members, one for each record, to a
file of its own in the shared folder, and returns index rows (file, offset,
length, url, digest, ...). Only the index rows of tasks that ended well are kept,
so files of lost or repeated attempts are never read.

Reading: the selected index rows are dealt by (file, offset), sorted, and ranges
that lie close together become one read of at most READ_BYTES.

Of records with equal payloads of at least LEAST_PAYLOAD bytes, the one with the
smallest page_id is a response, the others are revisits of it without a payload.
Which is which is decided on ids and digests; payloads are then joined to the
decision by id and digest, so many copies of a page never meet in one task.

Record ids are random UUIDs. A target URI is kept as it is; one with a line break,
which a header can't hold, has it percent-encoded there and is kept whole, as JSON,
in a header of our own, as are page ids. A revisit names its response by target
URI, payload digest and page id.

Defined results: null html is an empty payload; a null URL has no target header;
repeated rows with the smallest page_id of a payload are all responses; records
whose page_id is null revisit the smallest id, or are responses if there is none.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

LEAST_PAYLOAD = 100
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
FILE_BYTES = 1 << 30
#: Archive bytes that one reading task gets.
TASK_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
#: Begins the names of our own headers.
OWN = "Tessella-"

INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, refers_uri: str | None = None) -> bytes:
    """One record as a gzip member. The HTTP header keeps the full payload's length for revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
        if _line(url) != url:
            head.append(f"{OWN}Target-URI: {json.dumps(url)}")
    head.append(f"{OWN}Page: {json.dumps(page_id)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}", f"{OWN}Refers-To-Page: {json.dumps(refers_to)}"]
        head += [f"WARC-Refers-To-Target-URI: {_line(refers_uri)}"] if refers_uri is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict:
    """A record's fields from its gzip member; a response's digest is computed from its payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    whole = fields.get(f"{OWN}Target-URI")
    out = {
        "page_id": json.loads(fields[f"{OWN}Page"]),
        "url": fields.get("WARC-Target-URI") if whole is None else json.loads(whole),
        "record_type": fields["WARC-Type"],
        "refers_to": json.loads(fields.get(f"{OWN}Refers-To-Page", "null")),
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
    }
    if out["payload"] is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != out["payload_digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return out


def _writer(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        sink, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to", "refers_uri")]
                for i in range(len(batch)):
                    page_id, url, payload, digest, refers_to, refers_uri = (c[i].as_py() for c in columns)
                    revisit = refers_to is not None
                    raw = record(page_id, url, payload or b"", digest, refers_to, revisit, refers_uri)
                    if sink is None or at + len(raw) > FILE_BYTES:
                        if sink is not None:
                            sink.close()
                        fs.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    sink.write(raw)
                    rows.append({"page_id": page_id, "url": url, "file": name, "offset": at, "length": len(raw), "digest": digest, "record_type": "revisit" if revisit else "response"})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if sink is not None:
                sink.close()

    return run


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """Write ``pages``; returns the archives' folder and the index."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.length("payload") >= LEAST_PAYLOAD).select("page_id", "url", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_uri"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = slim.join(first, "digest").where("NOT page_id <=> refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to", "refers_uri").distinct()
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["p"]) & (rows["digest"] == again["d"]), "left").drop("p", "d")
    folder = _uri(f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return folder, stored(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def fetch(fs, root, run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        with fs.open_input_file(f"{root}/{run[0][0]}") as f:
            start = run[0][1]
            raw = f.read_at(run[-1][1] + run[-1][2] - start, start)
        return pa.RecordBatch.from_pylist([parse(raw[o - start : o - start + n]) for _, o, n in run], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True):
                if held and (file != held[-1][0] or offset > held[-1][1] + held[-1][2] + GAP_BYTES or offset + length - held[0][1] > READ_BYTES):
                    yield fetch(fs, root, held)
                    held = []
                held.append((file, offset, length))
        if held:
            yield fetch(fs, root, held)

    return run


def read(folder: str, index: DataFrame) -> DataFrame:
    """The records of the (selected) index rows; a revisit's payload is null.

    The number of tasks follows from the bytes to read: index rows are too small to tell.
    """
    places = index.select("file", "offset", "length")
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    folder, index = write(pages, **kw)
    return read(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
