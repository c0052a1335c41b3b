"""WARC archives: one gzip stream a file first, then a member a record with an offset index.

``write_archives`` lets each task stream its records into files that are one
gzip stream. ``normalise`` inflates each file once, start to end, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets.
``read_archives`` seeks by that index. Files lie in a folder that all machines
share and get their final name by a rename, so a task that runs again leaves
whole files; what counts is the table of files that each step writes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_folder

#: A task begins a new file beyond so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 1000
_STEP = 1 << 18
_EPOCH = "1970-01-01T00:00:00Z"


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def clean_uri(uri: str | None) -> str:
    """A header value can't hold line ends; they and blanks are percent-encoded."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in uri or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record, which has none."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", clean_uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return header(fields) + payload + b"\r\n\r\n"


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header, whole record)`` of each record of an uncompressed stream; holds one record at a time."""
    data = bytearray()
    for chunk in chunks:
        data += chunk
        while (end := data.find(b"\r\n\r\n")) >= 0:
            fields = parse_header(bytes(data[:end]))
            size = end + 4 + int(fields["Content-Length"]) + 4
            if len(data) < size:
                break
            yield fields, bytes(data[:size])
            del data[:size]
    if data:
        raise ValueError("the archive ends inside a record")


def inflate(source, step: int = _STEP) -> Iterator[bytes]:
    """The content of a gzip file, of one member or of many, in chunks of bounded size."""
    z = zlib.decompressobj(wbits=31)
    while data := source.read(step):
        while data:
            if out := z.decompress(data, step):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data + b""
                z = zlib.decompressobj(wbits=31)
    while out := z.decompress(z.unconsumed_tail, step) if z.unconsumed_tail else b"":
        yield out


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    store, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return store, path


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: ``refers_to`` is set for a row whose payload of 1000 bytes or more another row holds under a larger id."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    # equal payloads by two digests and the length
    rows = rows.withColumn("key", F.xxhash64("payload"))
    twice = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest", "key", "size").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1")
    twice = materialize(twice.select("digest", "key", "size", "most"), "payloads")
    joined = rows.join(twice, ["digest", "key", "size"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> most, null, most)").alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write files of one gzip stream each; ``(path, records)``, a row a file, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        store.create_dir(top, recursive=True)
        out, z, name, n, size, files = None, None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(z.flush())
                out.close()
                store.move(f"{top}/{name}.part", f"{top}/{name}")
                files.append((name, n))
                out = None

        for batch in batches:
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 4))
            for i, url, payload, digest, to in zip(ids, urls, batch.column(2), batch.column(3).to_pylist(), refers, strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = store.open_output_stream(f"{top}/{name}.part"), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = payload.as_py()
                out.write(z.compress(record(i, url, payload, digest, to, to is not None)))
                n, size = n + 1, size + len(payload)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([k for _, k in files], pa.int64())], ["path", "records"])

    return materialize(marked.mapInArrow(run, "path string, records long"), "archives")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite every record of each file as a gzip member, with a sidecar index of JSON lines; ``(path, records, bytes)``, a row a file, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(source)
        aim_store, aim = _place(target)
        aim_store.create_dir(aim, recursive=True)
        for batch in batches:
            done = []
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = uuid.uuid4().hex
                at = n = 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as raw, aim_store.open_output_stream(f"{aim}/{own}.part", compression=None) as out, aim_store.open_output_stream(f"{aim}/{own}.idx", compression=None) as index:
                    for fields, whole in records(inflate(raw)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"], "uri": fields["WARC-Target-URI"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, n = at + len(member), n + 1
                if n != expected:
                    raise ValueError(f"{name} holds {n} records of the {expected} that were written")
                final = f"{name.removesuffix('.warc.gz')}-{own}"
                aim_store.move(f"{aim}/{own}.part", f"{aim}/{final}.warc.gz")
                aim_store.move(f"{aim}/{own}.idx", f"{aim}/{final}.warc.gz.idx")
                done.append((f"{final}.warc.gz", n, at))
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * 3, kinds, strict=True)], ["path", "records", "bytes"])

    return materialize(_spread(files).mapInArrow(run, "path string, records long, bytes long"), "members")


def _spread(files: DataFrame) -> DataFrame:
    """One file a task, as far as there are tasks."""
    from .shared import shuffle_partitions

    return files.repartition(shuffle_partitions(files.sparkSession), "path")


def read_archives(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row a record, each read through the index: ``(page_id, record_type, refers_to, payload_bytes, payload_digest, uri[, payload])``.

    Payloads of responses are measured again and must have the length and digest
    that their header states, and each file must hold as many records as were
    written: a file that was cut is an error even where a record ends. No file
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        page = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "uri", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_file(f"{top}/{name}") as data, store.open_input_stream(f"{top}/{name}.idx", compression=None) as raw:
                    for line in _lines(raw):
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        ((fields, whole),) = records(iter([zlib.decompress(data.read(entry["length"]), wbits=31)]))
                        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = whole[whole.index(b"\r\n\r\n") + 4 : -4]
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {entry['offset']}: the payload isn't the one that its header states")
                        to = page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Type"], to, size, digest, fields["WARC-Target-URI"], *[payload] * with_payload))
                        held += 100 + len(payload) * with_payload
                        n += 1
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"the index of {name} lists {n} of {expected} records")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _spread(files).mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, uri string" + ", payload binary" * with_payload)


def _lines(source) -> Iterator[bytes]:
    rest = b""
    while data := source.read(_STEP):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Write ``pages`` as normalised archives below ``folder`` (by default a new one in the shared folder); the table of files, and their folder.

    Null html is the empty payload, a null id an empty record id, a null url an
    empty one. Of equal payloads of 1000 bytes or more the row with the largest
    id is the response; should that row repeat, each of its copies is one. Other
    columns aren't read; an empty table gives no file.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    whole = write_archives(mark_revisits(pages, id_col, url_col, html_col), f"{folder}/stream")
    members = normalise(whole, f"{folder}/stream", f"{folder}/members")
    # the single streams have served once the normalised files are all listed
    from .shared import drop

    drop(pages.sparkSession, f"{folder}/stream")
    return members, f"{folder}/members"
