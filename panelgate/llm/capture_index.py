"""WARC archives of web pages with a two-level capture index.

Every page is a record, a gzip member of its own, so a record can be read by its
byte range. The index lists captures by reversed-host URL key in sorted, compressed
blocks; beside each index part lies a sparse directory with the first key of every
block. A lookup finds the part, searches the part's directory, reads one block and
from it learns the record's place. Tasks write and read through the file system
that the shared folder's URI names.
"""

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import materialize, scratch_path

# Production parameters: captures in a block of the index, bytes after which an archive
# file is closed, gzip level, and the payload size from which equal payloads are stored once.
BLOCK_LINES, FILE_BYTES, LEVEL, LEAST_BYTES = 1000, 1 << 30, 4, 0

# Records of one archive that are fetched together lie in a stretch of this many bytes.
STRETCH = 64 << 20

DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``com,example,www)/path?query``."""
    rest = (url or "").strip()
    rest = rest.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, _, port = host.partition(":")
    labels = ",".join(reversed(host.rstrip(".").split(".")))
    return f"{labels}{':' + port if port not in ('', '80', '443') else ''}){path}"


def _opened(uri):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url):
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, first, name: str, first_url=None) -> bytes:
    """A gzip member with the WARC record of one page; a revisit has no payload.

    The record's id follows from ``name``, the record's place, so rows of one page have
    ids of their own. Pages stand in fields beside it.
    """
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {_target(first_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {first}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parsed(member: bytes) -> dict:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of a record.

    The digest of a stored payload is computed anew and has to be the recorded one.
    """
    whole = gzip.decompress(member)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def number(field):
        return int(fields[field]) if field in fields else None

    return {
        "page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the records and return their captures ``(url_key, page_id, file, at, length)``.

    Of equal payloads of ``least_bytes`` or more the one with the smallest ``page_id``
    is stored and the others refer to it; rows without an id come last and only refer
    to one that has an id. Each attempt of a task writes files of its own name, and
    the captures name the files of the attempt that succeeded.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1("html"))
    firsts = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha1")
        .agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
        .select("sha1", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    )
    known = rows.join(firsts, "sha1", "left").select(
        "page_id", "url", "html", "sha1", "first", "first_url"
    )
    root = folder.rstrip("/")

    def run(batches):
        fs, path = _opened(root)
        out = name = None
        try:
            for batch in batches:
                captures = []
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "first", "first_url")]
                payloads = batch.column("html").cast(pa.binary())
                for page_id, url, sha1, first, first_url, payload in zip(*columns, payloads):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = record(page_id, url, payload.as_py(), digest, first, f"{name}-{at}", first_url)
                    out.write(member)
                    captures.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*captures)) or [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["url_key", "page_id", "file", "at", "length"],
                )
        finally:
            if out is not None:
                out.close()

    _opened(root)[0].create_dir(_opened(root)[1], recursive=True)
    schema = "url_key string, page_id long, file string, at long, length long"
    return materialize(known.mapInArrow(run, schema), "captures")


def _key(url, page_id):
    return url, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Write sorted index parts and their directories; returns the parts' first keys and names.

    The parts are range partitions of ``(url_key, page_id)``, so even a URL captured
    a great many times is spread over several. One row per part reaches the driver.
    """
    root = folder.rstrip("/")

    def run(batches):
        fs, path = _opened(root)
        name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        at, first, last, directory, lines, keys = 0, None, None, [], [], []
        out = None

        def close_block():
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), LEVEL)
            out.write(data)
            directory.append([*keys[0], at, len(data)])
            at += len(data)
            lines.clear()
            keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.cdx", compression=None)
                    first = (row["url_key"], row["page_id"])
                last = (row["url_key"], row["page_id"])
                keys.append(last)
                lines.append(json.dumps([*last, row["file"], row["at"], row["length"]]))
                if len(lines) == block_lines:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        out.close()
        with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as sparse:
            sparse.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in (
                (first[0], pa.string()), (first[1], pa.int64()), (last[0], pa.string()),
                (last[1], pa.int64()), (name, pa.string()))],
            ["url_key", "page_id", "last_key", "last_id", "name"],
        )

    _opened(root)[0].create_dir(_opened(root)[1], recursive=True)
    ordered = captures.repartitionByRange(
        "url_key", F.col("page_id").asc_nulls_first(), F.xxhash64("file", "at")
    ).sortWithinPartitions("url_key", F.col("page_id").asc_nulls_first(), "file", "at")
    schema = "url_key string, page_id long, last_key string, last_id long, name string"
    parts = ordered.mapInArrow(run, schema).collect()
    return sorted(
        (_key(p["url_key"], p["page_id"]), _key(p["last_key"], p["last_id"]), p["name"])
        for p in parts
    )


def lookup(queries: DataFrame, folder: str, parts: list[tuple]) -> DataFrame:
    """Captures ``(url_key, page_id, file, at, length)`` whose ``(url, page_id)`` is asked for.

    Every capture is returned once, however often it is asked for. Queries are sorted
    like the index, so those of one block follow each other and a task holds one
    directory and one block at a time.
    """
    root = folder.rstrip("/")
    lasts = [p[1] for p in parts]

    def keyed(batches):
        for batch in batches:
            keys, ids, of = [], [], []
            for url, page_id in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist()):
                key = _key(url_key(url), page_id)
                # Equal keys may lie in several parts.
                for i in range(bisect.bisect_left(lasts, key), len(parts)):
                    if parts[i][0] > key:
                        break
                    keys.append(key[0])
                    ids.append(page_id)
                    of.append(parts[i][2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(of, pa.string())],
                ["url_key", "page_id", "part"],
            )

    def run(batches):
        fs, path = _opened(root)
        part = directory = firsts = source = block_at = block = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                key = _key(row["url_key"], row["page_id"])
                if row["part"] != part:
                    part, block_at = row["part"], None
                    with fs.open_input_file(f"{path}/{part}.dir") as sparse:
                        directory = json.loads(sparse.read())
                    firsts = [_key(d[0], d[1]) for d in directory]
                    source = fs.open_input_file(f"{path}/{part}.cdx")
                # The block before the first one that starts at the key may end with it.
                for i in range(max(bisect.bisect_left(firsts, key) - 1, 0), len(firsts)):
                    if firsts[i] > key:
                        break
                    if block_at != i:
                        source.seek(directory[i][2])
                        lines = zlib.decompress(source.read(directory[i][3])).decode().split("\n")
                        block = [json.loads(x) for x in lines]
                        block_keys, block_at = [_key(b[0], b[1]) for b in block], i
                    at = bisect.bisect_left(block_keys, key)
                    while at < len(block) and block_keys[at] == key:
                        found.append(block[at])
                        at += 1
            columns = list(zip(*found)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["url_key", "page_id", "file", "at", "length"],
            )

    asked = queries.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(
        keyed, "url_key string, page_id long, part string"
    ).distinct()
    ordered = asked.repartitionByRange("url_key", "page_id", "part").sortWithinPartitions(
        "part", "url_key", F.col("page_id").asc_nulls_first()
    )
    schema = "url_key string, page_id long, file string, at long, length long"
    return ordered.mapInArrow(run, schema)


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The captured records: ``url_key, page_id, payload_bytes, payload_digest, record_type,
    refers_to``, with ``payloads`` also ``payload`` (null for a revisit).

    Each record is one range read, in the order of the archive.
    """
    root = folder.rstrip("/")

    def run(batches):
        fs, path = _opened(root)
        name = source = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    source = fs.open_input_file(f"{path}/{name}")
                source.seek(row["at"])
                found.append({"url_key": row["url_key"]} | parsed(source.read(row["length"])))
            kinds = [
                ("url_key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("record_type", pa.string()),
                ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else []),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[c] for f in found], k) for c, k in kinds], [c for c, _ in kinds]
            )

    schema = "url_key string, page_id long, payload_bytes long, payload_digest string, " \
             "record_type string, refers_to long" + (", payload binary" if payloads else "")
    stretch = F.expr(f"at div {STRETCH}")
    grouped = captures.repartition("file", stretch).sortWithinPartitions("file", "at")
    return grouped.mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Write all pages and their index, then read every record back through the index.

    A null html is an empty payload, a null URL has the key ``)/``. Repeated rows are
    records of their own, with ids of their own; of several rows with one payload and the
    smallest page id each is a response. A page of any length is one record. An empty
    table writes nothing and gives none; other columns are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "archive")
    captures = write_archives(pages, folder, least_bytes)
    parts = write_index(captures, folder)
    return read_records(lookup(pages, folder, parts), folder)
