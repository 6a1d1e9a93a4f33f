import base64
import gzip
import hashlib
import random
import tracemalloc
import zlib

import pytest

from sluice.llm.warc import BadArchive, read, record_bytes, records, write


def sample(n=30):
    r = random.Random(3)
    out = []
    for i in range(n):
        body = bytes(r.randrange(256) for _ in range(r.choice([0, 1, 99, 100, 5000, 70_000])))
        out.append((body, record_bytes("response", f"urn:x:{i}", f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), {})))
    return out


@pytest.mark.parametrize("block", [1, 7, 4096, 1 << 20])
def test_reader(block):
    s = sample(12 if block < 8 else 30)
    data = b"".join(x for _, x in s)
    got = list(records(data, block))
    assert [r.payload for r in got] == [b for b, _ in s]
    assert [r.headers["warc-target-uri"] for r in got] == [f"http://x/{i}" for i in range(len(s))]
    assert [(r.payload, r.payload_bytes, r.payload_sha256) for r in records(data, block, keep_payload=False)] == [(b"", len(b), hashlib.sha256(b).hexdigest()) for b, _ in s]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= len(s)
    assert list(records(b"", block)) == []


def test_bad_archives():
    (body, data), *_ = [x for x in sample() if len(x[0]) == 5000]
    plain = zlib.decompress(data, 31)
    pack = lambda x: gzip.compress(x)
    for bad in (data[:-3], data + b"x", pack(plain[:-1]), pack(plain + b"y"), pack(plain.replace(body[:50], b"\0" * 50, 1)), pack(b"HTTP" + plain), pack(plain.replace(b"Content-Length: 5", b"Content-Length: 4", 1))):
        with pytest.raises(BadArchive):
            list(records(bad, 100))


def test_frame(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, "u", big), (3, "u\r\nWARC-Type: x", big), (3, None, big), (None, "u", big), (9, "u", small), (8, "u", small), (1, "u", None), (2, "u", ""), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = read(write(df, roll=1000))
    for r in got.collect():
        want = {5: (big, 3), 3: (big, None), None: (big, 3), 9: (small, None), 8: (small, None), 1: ("", None), 2: ("", None), 7: ("z" * 300_000, None)}[r.id]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(want[0].encode()), hashlib.sha256(want[0].encode()).hexdigest(), want[1])
        assert r.record_type == ("response" if want[1] is None else "revisit") and r.payload == (want[0] if want[1] is None else "")
    assert got.count() == len(rows) and got.select("archive").distinct().count() > 1
    assert read(write(df.limit(0))).count() == 0


def foreign(headers, block, tail=b"\r\n\r\n"):
    """A record as other writers make them."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(b"WARC/1.0\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + tail)


def test_foreign_files(spark, tmp_path):
    """Files by binaryFile: base 32 and unknown digests, folded headers, references by record id, records without HTTP."""
    body = "<html>été</html>".encode() * 20
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nCONTENT-LENGTH: %d\r\n\r\n" % len(body)
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    info = foreign({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:0>", "Content-Type": "application/warc-fields"}, b"software: x\r\n")
    page = foreign({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://x/1", "Content-Type": "application/http;\r\n\tmsgtype=response", "WARC-Payload-Digest": f"sha1:{b32(body)}", "WARC-Block-Digest": f"SHA1:{b32(http + body).lower()}"}, http + body)
    again = foreign({"warc-type": "revisit", "WARC-Record-ID": "<urn:uuid:2>", "WARC-Refers-To": "<urn:uuid:1>", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{b32(body)}"}, http)
    odd = foreign({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Block-Digest": "blake3:00", "WARC-Payload-Digest": f"md5:{hashlib.md5(b'abc').hexdigest()}"}, b"abc")
    (tmp_path / "a.warc.gz").write_bytes(info + page + again)
    (tmp_path / "b.warc.gz").write_bytes(odd)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {x.record_id: x for x in read(files, data_col="content", name_col="path").collect()}
    assert sorted(got) == ["urn:uuid:0", "urn:uuid:1", "urn:uuid:2", "urn:uuid:3"]
    assert got["urn:uuid:1"].payload.encode() == body and got["urn:uuid:1"].payload_digest == hashlib.sha256(body).hexdigest()
    r = got["urn:uuid:2"]
    assert (r.record_type, r.refers_to_record, r.payload_bytes, r.payload, r.id, r.refers_to, r.payload_digest) == ("revisit", "urn:uuid:1", len(body), "", None, None, None)
    assert got["urn:uuid:3"].payload == "abc" and got["urn:uuid:0"].payload_bytes == 13
    for bad in (foreign({"WARC-Type": "resource", "WARC-Block-Digest": f"sha1:{b32(b'other')}"}, b"abc"), foreign({"WARC-Type": "resource"}, b"abc", b"\r\n"), gzip.compress(b"WARC/1.0\r\n" + b"x" * (3 << 20))):
        with pytest.raises(BadArchive):
            list(records(bad))


def test_inflation_is_bounded():
    """A record of 200 MB in 200 KB of gzip: measured and digested without being held."""
    block = b"0" * (200 << 20)
    data = foreign({"WARC-Type": "resource", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}, block)
    tracemalloc.start()
    (r,) = records(data, keep_payload=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r.payload_bytes == len(block) and peak < 16 << 20
