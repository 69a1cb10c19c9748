"""WARC archives: writing, normalising monolithic gzip, reading by a sidecar index.

``write_archives`` makes one archive of each partition as a single gzip stream.
``normalise`` inflates such a stream once, from front to back, writes every
record as a gzip member of its own, and writes a sidecar index (a JSON line for
each record: offset, length, type, page). ``read_records`` goes to each record
by its index line. Files are written under a temporary name and then moved, and
their content depends on their partition alone, so a task that runs again
replaces its file by an equal one. Folders are URIs that the driver and all
executors share. Memory is bounded by one record's chunks when normalising and
by one record when writing or reading.

Defined cases: a null html is an empty payload; a null url or page_id has no
header and is read back as null; control characters in a URL are
percent-encoded; of equal payloads of at least ``least`` bytes the one with the
largest page_id is the response, and rows that repeat it are responses too;
empty tables give no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import remove, scratch_path, small_batches, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNK = 1 << 20


def base32_of(hexed: Column) -> Column:
    """Base32 of 40 hex digits."""
    parts = [F.conv(F.substring(hexed, 10 * g + 1, 10), 16, 10).cast("long") for g in range(4)]
    letter = lambda v, k: F.lit(BASE32).substr((F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(v, k) for v in parts for k in range(8)])


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to, name, of_name.

    ``name`` is the name of the record that is the only response with its payload
    (else null), ``of_name`` that of the record which a revisit refers to.

    Only payloads that occur twice or more are joined back, so the pages are
    not shuffled unless those are too many to broadcast; then a crowded digest
    can be split, since both sides of the join are plain tables.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha1", F.sha1(F.encode("html", "UTF-8")))
    long_enough = rows.where(F.octet_length("html") >= least)
    pages_of = long_enough.groupBy("_sha1", "page_id").agg(F.count("*").alias("_n"))
    shared = pages_of.groupBy("_sha1").agg(F.max("page_id").alias("_last"), F.sum("_n").alias("_n"), F.max_by("_n", F.struct("page_id")).alias("_m")).where("_n > 1")
    found = rows.join(stored(shared, "warc-shared"), "_sha1", "left").withColumn("_d", base32_of(F.col("_sha1")))
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    sole = F.when(F.col("_n").isNull(), F.octet_length("html") >= least).otherwise(~revisit & (F.col("_m") == 1))
    name = lambda page: F.concat(F.lit("urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), "_d")
    return found.select(
        "page_id", "url", "html", F.col("_d").alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"),
        F.when(sole, name(F.col("page_id"))).alias("name"), F.when(revisit & (F.col("_m") == 1), name(F.col("_last"))).alias("of_name"),
    )


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(page_id, url, html: str, digest: str, kind: str, refers_to, name: str | None, of_name: str | None, place: str = "") -> bytes:
    """A record. One without a name of its own is named by ``place``, which must differ from record to record."""
    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name or f'urn:x-record:{place}'}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: <{of_name}>"] if of_name else []
        lines += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _files(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return store, path


class _Moved:
    """An output file that gets its name when it is whole."""

    def __init__(self, store, path: str):
        import uuid

        self.store, self.path, self.part = store, path, f"{path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.file = self.store.open_output_stream(self.part, compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind:
            self.store.delete_file(self.part)
        else:
            self.store.move(self.part, self.path)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """archive, n_records: one monolithic archive of each partition that has rows. The files exist once this is computed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, top = _files(folder)
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        store.create_dir(top, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        run_id = top.rstrip("/").rsplit("/", 2)[-2]
        with _Moved(store, f"{top}/{name}") as out:
            press = zlib.compressobj(1, zlib.DEFLATED, 31)
            for batch in (b for some in ([first], batches) for b in some):
                for start in range(0, len(batch), 256):
                    for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                        out.write(press.compress(record_bytes(*row, f"{run_id}:{name}:{n}")))
                        n += 1
            out.write(press.flush())
        yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})

    return small_batches(rows).select("page_id", "url", "html", "payload_digest", "record_type", "refers_to", "name", "of_name").mapInArrow(run, "archive string, n_records long")


def _header(stream) -> list[bytes] | None:
    """Lines of the next record's header; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    lines = []
    while line not in (b"\r\n", b"\n", b""):
        lines.append(line.rstrip(b"\r\n"))
        line = stream.readline()
    return lines


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}


def normalise_stream(source, out) -> list[dict]:
    """Rewrite a gzip stream of records as one member a record; returns the index."""
    index, at = [], 0
    with gzip.GzipFile(fileobj=source) as stream:
        while (lines := _header(stream)) is not None:
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("a record must start with its version")
            fields = _fields(lines[1:])
            press, begin = zlib.compressobj(6, zlib.DEFLATED, 31), at
            left, pieces = int(fields["content-length"]), [press.compress(b"\r\n".join(lines) + b"\r\n\r\n")]
            while left:
                chunk = stream.read(min(left, CHUNK))
                if not chunk:
                    raise ValueError("a record ends before its length")
                left -= len(chunk)
                pieces.append(press.compress(chunk))
                if len(pieces) > 16:
                    at += out.write(b"".join(pieces))
                    pieces = []
            pieces += [press.compress(b"\r\n\r\n"), press.flush()]
            at += out.write(b"".join(pieces))
            index.append({"offset": begin, "length": at - begin, "type": fields.get("warc-type"), "page": fields.get("x-page-id")})
    return index


def normalise(archives: DataFrame, source: str, folder: str, tasks: int) -> DataFrame:
    """archive, n_records of the normalised archives; each has ``<archive>.index`` beside it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (store, top), (_, old) = _files(folder), _files(source)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{old}/{name}", compression=None, buffer_size=CHUNK) as stream, _Moved(store, f"{top}/{name}") as out:
                    index = normalise_stream(stream, out)
                with _Moved(store, f"{top}/{name}.index") as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(index)]})

    return archives.repartition(tasks).mapInArrow(run, "archive string, n_records long")


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, digest, type, refers_to) of one inflated record; a wrong digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not fit its digest")
    page, to = fields.get("x-page-id"), fields.get("x-refers-to-page")
    to = int(to) if to is not None else None
    return int(page) if page is not None else None, fields.get("warc-target-uri"), None if kind == "revisit" else payload, size, digest, kind, to


def read_records(archives: DataFrame, folder: str, tasks: int, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of all records, each sought by its index line."""
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, top = _files(folder)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
        names = [x.split()[0] for x in kinds.split(", ")]
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{top}/{name}.index", compression=None) as file:
                    index = [json.loads(x) for x in file.read().decode().splitlines()]
                with store.open_input_file(f"{top}/{name}") as file:
                    for start in range(0, len(index), 512):
                        rows = []
                        for entry in index[start : start + 512]:
                            file.seek(entry["offset"])
                            page, url, payload, size, digest, kind, to = parse_record(zlib.decompress(file.read(entry["length"]), 31))
                            rows.append((page, url, size, digest, kind, to, payload)[: len(types)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.repartition(tasks).mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read the normalised ones back."""
    folder = scratch_path(pages.sparkSession, "warc")
    written = stored(write_archives(records(pages, least), f"{folder}/monolithic"), "warc-written")
    tasks = max(1, written.count())
    normal = stored(normalise(written, f"{folder}/monolithic", f"{folder}/normal", tasks), "warc-normal")
    remove(pages.sparkSession, f"{folder}/monolithic")
    return read_records(normal, f"{folder}/normal", tasks)
