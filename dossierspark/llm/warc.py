"""WARC archives, index first.

*Write.* Every task writes its rows as gzip members to archives of its own in the shared folder, a new file beyond ``ARCHIVE_BYTES``, and
returns one index row a record: archive, offset, length, url, digest and record type. The index is what is trusted: a task that
is repeated or lost leaves an archive that no index row names. Html is not shuffled; only digests are, to find equal payloads.

*Read.* The wanted index rows are range-partitioned by archive and offset. A task merges sorted ranges that lie within ``GAP`` bytes of
each other into one read of at most ``SPAN`` bytes (a longer record is a read of its own), cuts the records out, checks them against
the digest and parses them. There are as many tasks as cores at least, and one for about ``TASK_BYTES`` of records, however short
their index rows are. One large archive is read by many tasks.

Files go through ``pyarrow.fs``, so the shared folder may lie in any store that it opens.

A response's block is an HTTP response with the payload; a revisit's block is its HTTP header alone, whose Content-Length tells the size of
the payload, with the profile for identical payload digests.

Defined results: null payloads are empty. Among records with equal payloads of at least ``LEAST`` bytes those of the smallest id are
responses (one, unless rows repeat that id), all others revisit it; null ids come last. Shorter payloads are responses. A null url leaves
out the target; control characters and blanks in urls are percent-encoded in the record and kept in the index. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierspark.llm.rows import checked_broadcast, give_back, quoted
from dossierspark.session import durable, scratch_path

ARCHIVE_BYTES, LEAST = 1 << 30, 100
GAP, SPAN, TASK_BYTES = 64 << 10, 8 << 20, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, id long, url string, digest string, record_type string"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _named(id_) -> str:
    return f"<urn:record:{'' if id_ is None else id_}>"


def _target(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(id_, url: str | None, payload: bytes, digest: str, first: tuple | None, date: str) -> bytes:
    """One record, uncompressed; ``first`` is (id, url) of the response that this payload revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _named(id_)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _target(url)))
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(first[0]))]
        if first[1] is not None:
            fields.append(("WARC-Refers-To-Target-URI", _target(first[1])))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.casefold(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def _id_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:record:").removesuffix(">")
    return int(digits) if digits else None


def parse(raw: bytes) -> dict:
    """The parts of one uncompressed record. A payload that does not fit its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record is cut")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    return {"id": _id_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": _id_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


class Archive:
    """One archive file that a task writes; each record is a gzip member."""

    def __init__(self, folder: str, date: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, place = pyarrow.fs.FileSystem.from_uri(self.path)
        self.file, self.at = fs.open_output_stream(place, compression=None), 0
        about = b"software: dossierspark\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
        self.add(head.encode() + about + b"\r\n\r\n")

    def add(self, raw: bytes) -> tuple[str, int, int]:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.file.write(member)
        place = self.path, self.at, len(member)
        self.at += len(member)
        return place


def first_copies(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, first id, its url) of each payload of ``least`` bytes or more that stands in several rows."""
    return pages.filter(F.col("_size") >= least).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("_first")).filter("_n > 1").drop("_n")


def write(pages: DataFrame, id_: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
          date: str = "1970-01-01T00:00:00Z", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives in ``folder`` and returns the index (see ``INDEX``), itself a written table."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    _make_folder(folder)
    body = F.coalesce(quoted(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(quoted(id_).cast("long").alias("id"), quoted(url).cast("string").alias("url"), body.alias("_payload"))
    rows = rows.withColumns({"_digest": F.sha2("_payload", 256), "_size": F.octet_length("_payload")})
    first = checked_broadcast(durable(first_copies(rows.drop("_payload"), least)))
    rows = rows.join(first, "_digest", "left").select("id", "url", "_payload", "_digest", F.when(
        F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first.id")), F.col("_first")).alias("_first"))
    schema = StructType.fromDDL(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            out = {k: [] for k in schema.names}
            ids, urls, payloads, digests, firsts = batch.columns
            for i in range(batch.num_rows):
                if archive is None or archive.at >= archive_bytes:
                    if archive:
                        archive.file.close()
                    archive = Archive(folder, date)
                own, link, digest, of = ids[i].as_py(), urls[i].as_py(), digests[i].as_py(), firsts[i].as_py()
                place = archive.add(record(own, link, payloads[i].as_py(), digest, of and (of["id"], of["url"]), date))
                for k, v in zip(schema.names, (*place, own, link, digest, "revisit" if of else "response")):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()),
                                                             ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]))
        if archive:
            archive.file.close()
        give_back()

    return durable(rows.mapInArrow(run, schema))


def _make_folder(folder: str) -> None:
    fs, place = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(place, recursive=True)


def ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted (archive, offset, length) rows in runs that one read covers."""
    run: list[tuple[str, int, int]] = []
    end = 0
    for row in rows:
        archive, offset, length = row
        if run and (archive != run[0][0] or offset > end + gap or max(end, offset + length) - run[0][1] > span):
            yield run
            run = []
        end = max(end, offset + length) if run else offset + length
        run.append(row)
    if run:
        yield run


def read(selected: DataFrame, payload: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records (see ``RECORD``) of the index rows ``selected``; without ``payload`` its column stays null, but it is read and checked."""
    types = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows_of(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for group in ranges(rows_of(batches), gap, span):
            if group[0][0] != name:
                name = group[0][0]
                fs, place = pyarrow.fs.FileSystem.from_uri(name)
                file = fs.open_input_file(place)
            start = group[0][1]
            raw = file.read_at(max(o + n for _, o, n in group) - start, start)
            out, held = [], 0
            for _, offset, length in group:
                found = parse(zlib.decompress(raw[offset - start:offset - start + length], 31))
                if not payload:
                    found["payload"] = None
                out.append(found)
                held += len(found["payload"] or b"")
                if held > span:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, types)
        give_back()

    wanted = selected.select("archive", "offset", "length")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    placed = wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All ``pages`` written, indexed and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    return read(write(pages), payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
