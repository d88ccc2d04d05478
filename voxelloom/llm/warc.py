"""WARC archives: whole-file gzip streams normalised to one gzip member a record, with a sidecar index of offsets.

`record` writes pages as response records, each file one gzip stream, as crawlers that compress a finished file leave it: such a
file can only be read from its start.  `normalise` inflates a stream once, in pieces, and writes every record as a member of its
own; on the way, responses whose payload another record holds become revisits.  Beside each archive it writes an index, one JSON
line a record.  `read` seeks to the members by that index and never inflates anything else.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import words as W
from voxelloom.llm.setup import ready, stored
from voxelloom.session import scratch_path
from voxelloom.sources.files import open_fs, qualified

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shorter payloads are never revisited.
LEAST = 1000
#: Bytes read and inflated at a time.
PIECE = 1 << 20
#: A record's or block's header lines must end within so many bytes.
HEADER = 1 << 20

RECORDS = "file string, at long, page_id long, record string, digest string, size long"
FILES = "file string, archive string, index string, records long"
PAGES = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, "
         "offset long, length long, payload binary")


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def head(fields: dict[str, str]) -> bytes:
    return "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in fields.items()], "", ""]).encode()


def fields(lines: bytes) -> dict[str, str]:
    """Header lines of a record; raises where they are none."""
    first, *rest = lines.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:60]!r}")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


class Archive:
    """A file that is one gzip stream, written record by record."""

    def __init__(self, path: str, date: str):
        fs, inner = open_fs(path)
        fs.create_dir(posixpath.dirname(inner), recursive=True)
        self.path, self.date, self.sink, self.gzip = path, date, fs.open_output_stream(inner, compression=None), zlib.compressobj(6, wbits=31)
        self.size = self.records = 0
        body = b"format: WARC File Format 1.1\r\n"
        self._put(head({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(path), "WARC-Date": date, "Content-Type": "application/warc-fields",
                        "Content-Length": str(len(body))}), body)

    def _put(self, *parts: bytes) -> None:
        for part in (*parts, b"\r\n\r\n"):
            self.size += len(part)
            self.sink.write(self.gzip.compress(part))

    def add(self, page: int | None, url: str | None, payload: bytes) -> tuple:
        digest, name = hashlib.sha1(payload).hexdigest(), record_id(self.path, self.records)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        known = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": self.date}
        if url is not None:
            known["WARC-Target-URI"] = _line(url)
        known |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", "X-Payload-Length": str(len(payload))}
        if page is not None:
            known["X-Page-ID"] = str(page)
        self._put(head(known | {"Content-Length": str(len(http) + len(payload))}), http, payload)
        self.records += 1
        return self.path, self.records - 1, page, name, digest, len(payload)

    def close(self) -> None:
        self.sink.write(self.gzip.flush())
        self.sink.close()


def record(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
           file_bytes: int = 64 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write pages as response records, each task its own files of about `file_bytes`; one row a record (see RECORDS).

    A null html is empty, a null url or id is left out of the record.  Repeated rows are records of their own.  A file's name
    belongs to one attempt of a task; only files of the returned table count.
    """
    folder = qualified(pages.sparkSession, folder)
    used = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for whole in batches:
            for batch in W.slices(whole, "html", PIECE):
                data, offsets = W.flat(batch.column(2))
                rows = []
                for page, target, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if archive and archive.size >= file_bytes:
                        archive.close()
                        archive = None
                    archive = archive or Archive(f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", date)
                    rows.append(archive.add(page, target, data[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["file", "at", "page_id", "record", "digest", "size"])
        if archive:
            archive.close()

    return used.mapInArrow(run, RECORDS)


class Stream:
    """The inflated bytes of a gzip file, of one member or many, in pieces; read once from its start."""

    def __init__(self, source):
        self.source, self.held, self.rest = source, bytearray(), b""
        self.gzip, self.begun, self.done = zlib.decompressobj(31), False, False

    def _more(self) -> bool:
        """Inflate one piece more; False at the end of the file."""
        while not self.done:
            data = self.rest or self.source.read(PIECE)
            if not data and (self.gzip.eof or not self.begun):
                self.done = True
                return False
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
            out = self.gzip.decompress(data, PIECE)
            if not data and not out and not self.gzip.eof:
                raise ValueError("gzip stream ends early")
            self.rest = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            self.begun = True
            if out:
                self.held += out
                return True
        return False

    def lines(self) -> bytes | None:
        """Bytes up to an empty line, without it; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > HEADER:
                raise ValueError("header lines without an end")
            if not self._more():
                if self.held.strip():
                    raise ValueError("record ends early")
                return None
        out = bytes(self.held[:at])
        del self.held[:at + 4]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes in pieces."""
        while size:
            if not self.held and not self._more():
                raise ValueError("record ends early")
            piece = bytes(self.held[:size])
            del self.held[:size]
            size -= len(piece)
            yield piece


def rewrite(source, sink, revisits: dict[str, dict[str, str]]) -> Iterator[dict]:
    """Copy every record of a stream to a member of its own in `sink`; yield its index entry.

    `revisits`: record id -> header fields; such a response keeps its header and HTTP lines, loses its payload and
    becomes a revisit.  Records are copied in pieces, whatever their size.
    """
    stream, offset = Stream(source), 0
    while (lines := stream.lines()) is not None:
        known = fields(lines)
        size = int(known["Content-Length"])
        member, length = zlib.compressobj(6, wbits=31), 0

        def put(data: bytes) -> int:
            packed = member.compress(data)
            sink.write(packed)
            return len(packed)

        more = revisits.get(known.get("WARC-Record-ID", ""))
        if more is not None:
            http = b""
            body = stream.take(size)
            for piece in body:
                if b"\r\n\r\n" not in http:
                    http = (http + piece)[:HEADER]
            http = http[:http.find(b"\r\n\r\n") + 4]
            known |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, **more, "Content-Length": str(len(http))}
            length += put(head(known)) + put(http)
        else:
            length += put(head(known))
            for piece in stream.take(size):
                length += put(piece)
        for _ in stream.take(4):  # the empty line after a record
            pass
        tail = member.compress(b"\r\n\r\n") + member.flush()
        sink.write(tail)
        length += len(tail)
        yield {"offset": offset, "length": length, "type": known.get("WARC-Type"), "record": known.get("WARC-Record-ID"), "uri": known.get("WARC-Target-URI"),
               "digest": known.get("WARC-Payload-Digest")}
        offset += length


def repeats(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, record, page, first): records whose payload of `least` bytes or more another one holds, and which one.

    That with the largest page id stays (null is smallest); among rows that repeat an id, one of them.
    """
    big = records.where(F.col("size") >= least)
    stays = big.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record")).alias("won")).where("n > 1")
    found = big.select("file", "record", "digest", "size").join(stays.drop("n"), ["digest", "size"]).where("record <> won.record")
    return found.select("file", "record", F.col("won.page_id").alias("page"), F.col("won.record").alias("first"))


def normalise(records: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """Rewrite the files that `record` wrote; one row a file with its archive and index (see FILES).

    A task holds one piece of a stream and the revisits of its file (their number is bounded by the file's size).
    """
    folder = qualified(records.sparkSession, folder)
    listed = repeats(records, least).groupBy("file").agg(F.collect_list(F.struct("record", "page", "first")).alias("revisits"))
    files = stored(records.groupBy("file").agg(F.count("*").alias("records")).join(listed, "file", "left"), "warc-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                known = {r["record"]: {"WARC-Refers-To": r["first"], "WARC-Refers-To-Date": date,
                                       **({"X-Refers-To-Page-ID": str(r["page"])} if r["page"] is not None else {})} for r in row["revisits"] or []}
                fs, raw = open_fs(row["file"])
                out, inner = open_fs(name)
                out.create_dir(posixpath.dirname(inner), recursive=True)
                with fs.open_input_stream(raw, compression=None) as source, out.open_output_stream(inner, compression=None) as sink, out.open_output_stream(inner + ".idx") as index:
                    for entry in rewrite(source, sink, known):
                        index.write(json.dumps(entry).encode() + b"\n")
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "archive": name, "index": name + ".idx", "records": row["records"]}], pa.schema(
                    [("file", pa.string()), ("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return stored(files.repartition(max(1, files.count())).mapInArrow(run, FILES), "warc-archives")


def member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(header, block) of the record whose member lies at `offset`."""
    data = zlib.decompress(source.read_at(length, offset), wbits=31)
    end = data.find(b"\r\n\r\n")
    known = fields(data[:end])
    size = int(known["Content-Length"])
    return known, data[end + 4:end + 4 + size]


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Every response and revisit of the archives, each member reached by its offset (see PAGES).

    payload_bytes and payload_digest (bare hexadecimal SHA-1) are those of the full payload: computed from what a response
    holds, which must equal its header, and taken from the header of a revisit.  `payload` is null unless `payloads`.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = open_fs(archive)
                out, held = [], 0
                with fs.open_input_file(inner) as source, fs.open_input_stream(open_fs(index)[1]) as entries:
                    for line in lines(entries):
                        entry = json.loads(line)
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        known, block = member(source, entry["offset"], entry["length"])
                        digest, size, payload = known["WARC-Payload-Digest"].removeprefix("sha1:"), int(known["X-Payload-Length"]), None
                        if entry["type"] == "response":
                            payload = block[block.find(b"\r\n\r\n") + 4:]
                            if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                                raise ValueError(f"payload of {known['WARC-Record-ID']} in {archive} does not have its digest")
                        page, first = known.get("X-Page-ID"), known.get("X-Refers-To-Page-ID")
                        out.append({"page_id": page and int(page), "url": known.get("WARC-Target-URI"), "record_type": entry["type"], "refers_to": first and int(first),
                                    "payload_bytes": size, "payload_digest": digest, "archive": archive, "offset": entry["offset"], "length": entry["length"],
                                    "payload": payload if payloads else None})
                        held += len(block) if payloads else 0
                        if len(out) >= 2000 or held > 4 * PIECE:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("archive", "index").repartition(max(1, files.count())).mapInArrow(run, PAGES)


def lines(source) -> Iterator[bytes]:
    """Lines of a stream, a piece at a time."""
    held = b""
    while data := source.read(PIECE):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """`record`, then `normalise`: one row a file.  `folder`: where the files go, a fresh one in the shared place by default.

    No pages give no files.  Columns beside id, url and html are ignored.
    """
    spark: SparkSession = ready(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    return normalise(stored(record(pages, folder, **options), "warc-records"), folder)
