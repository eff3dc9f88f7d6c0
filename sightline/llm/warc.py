"""WARC archives: monolithic gzip files normalised to a member a record, with an offset index.

Pass 1 writes each task's pages, in one gzip stream, as plain response records and
reports a light row a record. Pass 2 finds, from those rows alone, the equal payloads
(SHA-256; at least ``least`` bytes): the smallest page_id stays a response, others
become revisits of it. Pass 3 inflates each monolithic file once, as a stream, and
writes every record as a gzip member of its own beside an index (offset, length, id)
that lets a reader take one record without the rest. Payloads never shuffle.

Null html is an empty payload. Equal page_ids that are smallest all stay responses. A
null page_id ranks after all others; where a group has only nulls, all are responses.
Record ids are made of page_id, digest and, for rows alike in both but the first, their
place; a revisit names its original's id and address (WARC-Refers-To). A very long page
is one record, held whole once. An empty table gives no archives; columns other than
page_id, url and html play no part.
A rerun task writes under a new name, and only names in the manifests are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, open_fs, scratch

INDEX = struct.Struct("<QQ?q")  # offset, length, id is null, id
DATE = "2024-01-01T00:00:00Z"  # a fixed date: reruns give the same bytes
LEVEL = 3
STEP = 1 << 18


def index_entry(offset: int, length: int, page: int | None) -> bytes:
    return INDEX.pack(offset, length, page is None, page or 0)


def index_entries(raw: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each record, in the file's order."""
    return [x[:2] for x in INDEX.iter_unpack(raw)]


def record_id(page: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{place}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers: int | None = None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the page it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page: {refers}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def header(raw: bytes) -> tuple[dict[str, str], int]:
    """Fields of the record at the start of raw (names in lower case), and where its block begins; -1: not all there."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def records(stream):
    """(fields, block) of each record of a gzip file, inflated as a stream, members or not; holds one record and a step."""
    inflate, held, data = zlib.decompressobj(31), b"", stream.read(STEP)
    while True:
        at = 0
        while at < len(held):
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields, _ = header(held[at : end + 4])
            size = int(fields["content-length"])
            if end + 4 + size + 4 > len(held):
                break
            yield fields, held[end + 4 : end + 4 + size]
            at = end + 4 + size + 4
        held, more = held[at:], []
        while sum(map(len, more)) <= len(held):  # so a record of n bytes is looked at log n times
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
            data = data or stream.read(STEP)
            if not data:
                break
            more.append(inflate.decompress(data, 4 * STEP))
            data = inflate.unconsumed_tail
        if not more:
            if held:
                raise ValueError("the archive ends within a record")
            return
        held += b"".join(more)


def write_monolithic(pages: DataFrame) -> DataFrame:
    """Pass 1; a row a record: file, k (its place), page_id, digest, bytes."""
    out = scratch(pages.sparkSession, "warc-mono")

    def write(batches):
        give_back()
        sink = pack = uri = None
        k = 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                if sink is None:
                    uri = f"{out}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sink, pack = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                sink.write(pack.compress(record("response", page_id.as_py(), url.as_py(), payload, digest, len(payload))))
                rows.append((uri, k, page_id.as_py(), digest, len(payload)))
                k += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["file", "k", "page_id", "digest", "bytes"])
        if sink is not None:
            sink.write(pack.flush())
            sink.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(rows.mapInArrow(write, "file string, k long, page_id long, digest string, bytes long"), "warc-records")


def normalise(written: DataFrame, least: int = 100) -> DataFrame:
    """Passes 2 and 3; a row a normalised file: path, index, records."""
    out = scratch(written.sparkSession, "warc")
    firsts = written.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    same = written.join(firsts, "digest", "left").where("first is not null and not (page_id <=> first)").select("file", "k", "first")
    # of rows alike in id and payload one has the plain record id; the others' hold their place
    twins = written.groupBy("page_id", "digest").agg(F.count("*").alias("m"), F.min(F.struct("file", "k")).alias("f")).where("m > 1")
    alike = F.col("w.page_id").eqNullSafe(F.col("t.page_id")) & (F.col("w.digest") == F.col("t.digest"))
    later = written.alias("w").join(twins.alias("t"), alike).where("w.file <> t.f.file or w.k <> t.f.k").select("w.file", "w.k")
    notes = same.select("file", "k", "first", F.lit(False).alias("later")).unionByName(later.select("file", "k", F.lit(None).cast("long").alias("first"), F.lit(True).alias("later")))
    revisits = notes.groupBy("file").agg(F.collect_list(F.struct("k", "first", "later")).alias("again"))  # at most one file's records
    files = written.groupBy("file").agg(F.count("*").alias("n"))
    work = files.join(revisits, "file", "left").select("file", "again")

    def rewrite(batches):
        give_back()
        for batch in batches:
            for file, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {r["k"]: r["first"] for r in again or [] if not r["later"]}
                later = {r["k"] for r in again or [] if r["later"]}
                name = file.rpartition("/")[2]
                uri = f"{out}/{uuid.uuid4().hex}.warc.gz"
                (source, source_path), (fs, path) = open_fs(file), open_fs(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                offset = n = 0
                with source.open_input_stream(source_path, compression=None) as stream, fs.open_output_stream(path, compression=None) as sink, fs.open_output_stream(path + ".idx", compression=None) as index:
                    for k, (fields, block) in enumerate(records(stream)):
                        page = int(fields["x-page-id"]) if "x-page-id" in fields else None
                        length = int(fields["x-payload-length"])
                        kind, payload = ("revisit", b"") if k in refers else ("response", block[block.index(b"\r\n\r\n") + 4 :])
                        raw = record(kind, page, fields.get("warc-target-uri"), payload, fields["warc-payload-digest"].partition(":")[2], length, refers.get(k), f"{name}/{k}" if k in later else "")
                        pack = zlib.compressobj(LEVEL, wbits=31)
                        member = pack.compress(raw) + pack.flush()
                        sink.write(member)
                        index.write(index_entry(offset, len(member), page))
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pylist([{"path": uri, "index": uri + ".idx", "records": n}], schema=pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    n = max(1, files.count())
    return materialize(work.repartition(n, "file").mapInArrow(rewrite, "path string, index string, records long"), "warc-manifest")


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, from its member alone."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        raw = zlib.decompress(file.read_at(length, offset), 31)
    fields, at = header(raw)
    return fields, raw[at : at + int(fields["content-length"])]


def read_back(manifest: DataFrame) -> DataFrame:
    """A row a record of the archives, each member found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        give_back()
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (fs, path), rows = open_fs(uri), []
                with fs.open_input_stream(open_fs(index)[1], compression=None) as f:
                    places = index_entries(f.read())
                with fs.open_input_file(path) as file:
                    for offset, length in places:
                        raw = zlib.decompress(file.read_at(length, offset), 31)
                        fields, at = header(raw)
                        size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].partition(":")[2]
                        if fields["warc-type"] == "response":
                            block = raw[at : at + int(fields["content-length"])]
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        rows.append({"page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None})
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path", "index").repartition(n, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    return read_back(normalise(write_monolithic(pages)))
