"""Archives and index: every page comes back as it went in."""

import base64
import gzip
import hashlib
import random

import pytest

from panelgate.llm import capture_index as ci
from panelgate.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = (html or "") in first and first[html or ""] != page_id
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response",
                    first[html or ""] if revisit else None))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        html = rng.choice(["same", "", None, f"<p>é {i}\r\n\r\nWARC/1.1 {'x' * rng.randint(0, 400)}</p>"])
        url = rng.choice(["http://hot.example.com/", f"https://h{i % 7}.example.org:8080/p?{i}", None, f"x {i}\r\n"])
        rows.append((i, url, html))
    return rows + rows[:3] + [(None, "http://a/", "same"), (None, None, "only here"), (400, "http://a/", "y" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(5)


def test_pages_come_back(pages, monkeypatch):
    rows = ci.archive(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ).collect()
    assert sorted(map(tuple, rows), key=str) == expected(sample())


def test_lookup_reads_the_blocks_of_the_key(spark, pages):
    folder = scratch_path(spark, "test")
    captures = ci.write_archives(pages, folder)
    parts = ci.write_index(captures, folder, block_lines=7)
    every = {(c.url_key, c.page_id, c.file, c.at) for c in captures.collect()}
    asked = spark.createDataFrame(
        [(u, i) for i, u, _ in sample()[::5]] + [("http://nowhere/", 1), (None, None)],
        "url string, page_id long",
    )
    found = [(c.url_key, c.page_id, c.file, c.at) for c in ci.lookup(asked, folder, parts).collect()]
    wanted = {(ci.url_key(u), i) for i, u, _ in sample()[::5]} | {(")/", None)}
    assert len(found) == len(set(found))
    assert set(found) == {e for e in every if e[:2] in wanted}
    payloads = ci.read_records(ci.lookup(asked, folder, parts), folder, payloads=True).collect()
    texts = {i: h for i, _, h in sample()}
    assert all(r.payload.decode() == (texts[r.page_id] or "") for r in payloads
               if r.record_type == "response" and r.page_id is not None)


def test_files_are_gzip_members(spark, pages):
    folder = scratch_path(spark, "test")
    captures = ci.write_archives(pages, folder).collect()
    fs, path = ci._opened(folder)
    name = captures[0].file
    with fs.open_input_file(f"{path}/{name}") as f:
        whole = gzip.decompress(f.read())
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: re") and whole.endswith(b"\r\n\r\n")
    assert whole.count(b"WARC-Record-ID") == sum(c.file == name for c in captures)


def test_record_ids_are_unique_and_pages_keep_theirs(spark):
    rows = [(1, "u", "x")] * 3 + [(1, "v", "y"), (2, "w\n", "x"), (None, "u", "x"), (None, "u", "z")]
    folder = scratch_path(spark, "test")
    captures = ci.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    fs, path = ci._opened(folder)
    heads = []
    for c in captures.collect():
        with fs.open_input_file(f"{path}/{c.file}") as f:
            f.seek(c.at)
            heads.append(gzip.decompress(f.read(c.length)).split(b"\r\n\r\n")[0].decode().split("\r\n"))
    ids = [x for h in heads for x in h if x.startswith("WARC-Record-ID: <urn:uuid:")]
    assert len(set(ids)) == len(rows)
    revisits = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(revisits) == 2
    assert all("WARC-Refers-To-Target-URI: u" in h and "X-Refers-To-Page-ID: 1" in h for h in revisits)


def test_other_columns_are_not_read(spark):
    names = ["sha1", "first", "n", "file", "at", "length", "url_key", "part", "payload"]
    rows = [(*r, *range(len(names))) for r in sample()]
    wide = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} long" for c in names))
    found = ci.archive(wide).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ).collect()
    assert sorted(map(tuple, found), key=str) == expected(sample())


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    kinds = {r.page_id: r.record_type for r in ci.archive(pages, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damage_is_an_error():
    member = ci.record(1, "u", b"payload", ci.base32_sha1(b"payload"), None, "n")
    damaged = gzip.compress(gzip.decompress(member).replace(b"payload", b"PAYLOAD"))
    assert ci.parsed(member)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        ci.parsed(damaged)


def test_url_keys():
    assert ci.url_key("https://user@WWW.Example.com:443/a/b?q=1#f") == "com,example,www)/a/b?q=1"
    assert ci.url_key("http://example.com:8080?x") == "com,example:8080)?x"
    assert ci.url_key(None) == ci.url_key("") == ")/"


def test_no_pages(spark):
    assert ci.archive(spark.createDataFrame([], SCHEMA)).collect() == []
