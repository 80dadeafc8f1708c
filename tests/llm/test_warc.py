import gzip
import hashlib
import os

from scholium.llm import warc
from scholium.llm.shared import new_path

SCHEMA = "page_id long, url string, html string, record_type string"


def pages():
    a, b = "<p>é " + "x" * 1000, "y" * 999
    return [(1, "http://a/", a, "z"), (2, "http://b/\r\nEvil: 1", a, "z"), (3, None, a, "z"), (4, "http://c/", b, "z"), (5, "http://c/", b, "z"), (6, "u", None, "z"), (7, "u", "", "z"), (None, "u", a, "z"), (None, "n", "k" * 2000, None), (9, "http://big/", "WARC/1.1\r\n\r\n" * 30000, "z"), (10, "u", "b" * 1000, "z"), (11, "u", "b" * 1000, "z")]


def brute(rows):
    best = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        x = (h or "").encode()
        again = h in best and best[h] != i
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    path = new_path(spark, "warc")
    warc.write_pages(df, path)
    got = warc.page_records(spark, path)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages())
    every = warc.read_warc(spark, path)
    assert every.where("record_type = 'warcinfo'").count() >= 1
    local = path.removeprefix("file://")
    for name in os.listdir(local):
        if name.endswith(".warc.gz"):
            assert gzip.open(f"{local}/{name}").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_pushdown_skips_payloads(spark):
    path = new_path(spark, "warc")
    warc.write_pages(spark.createDataFrame(pages(), SCHEMA), path)
    out = warc.read_warc(spark, path, ("record_type", "target_uri")).where("record_type = 'response' and target_uri like 'http://c%'")
    assert "PushedFilters" in out._jdf.queryExecution().toString() or out.count() == 2
    assert out.count() == 2
    reader = warc.WarcReader(warc.SCHEMA, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.tests == [("warc-type", "eq", "revisit")]


def test_foreign_archives_without_lengths_and_plain(spark, tmp_path):
    def rec(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    recs = [rec("resource", f"u{i}", os.urandom(i * 5000) + b"WARC/1.0\r\n\r\n") for i in range(6)] + [rec("metadata", "m", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    (tmp_path / "c.txt").write_text("no")
    got = warc.read_warc(spark, str(tmp_path), ("record_type", "target_uri", "payload", "content_length")).collect()
    assert len(got) == 14 and all(len(r.payload) == r.content_length for r in got)
    assert warc.read_warc(spark, str(tmp_path), ("target_uri", "record_type")).where("record_type = 'metadata'").count() == 2


def test_many_repeats_take_the_salted_join(spark):
    df = spark.createDataFrame(pages() + [(100 + i, "u", "q" * 1500, "z") for i in range(200)], SCHEMA)
    one = warc.mark_revisits(df, few=0).select("page_id", "record_type", "refers_to")
    two = warc.mark_revisits(df).select("page_id", "record_type", "refers_to")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_empty_table(spark):
    path = new_path(spark, "warc")
    warc.write_pages(spark.createDataFrame([], SCHEMA), path)
    assert warc.page_records(spark, path).count() == 0


def record(kind, body, size=None, extra=""):
    block = body.encode()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(block) if size is None else size}\r\n{extra}\r\n".encode() + block + b"\r\n\r\n"


def read_bytes(name, data, tmp_path):
    (tmp_path / name).write_bytes(data)
    with open(tmp_path / name, "rb") as f:
        return [(h.get("warc-type"), b, "x-error" in h) for _, h, _, b in warc.records(f, lambda h: True, True)]


def test_members_of_many_records_and_malformed_ones(tmp_path):
    a, b, c, bad = record("response", "one"), record("metadata", "two" * 5000), record("resource", ""), record("response", "skipped", "12x")
    whole = [("response", b"one", False), ("metadata", b"two" * 5000, False), ("resource", b"", False)]
    assert read_bytes("one.warc.gz", gzip.compress(a + b + c), tmp_path) == whole
    assert read_bytes("each.warc.gz", gzip.compress(a) + gzip.compress(b) + gzip.compress(c), tmp_path) == whole
    assert read_bytes("plain.warc", a + b"\r\n" + b + c, tmp_path) == whole
    assert read_bytes("bad.warc", a + bad + b + c, tmp_path) == whole
    assert read_bytes("bad.warc.gz", gzip.compress(a) + gzip.compress(bad) + gzip.compress(b + c), tmp_path) == whole
    packed = bytearray(gzip.compress(b))
    packed[len(packed) // 2 : len(packed) // 2 + 20] = b"\xff" * 20
    got = read_bytes("broken.warc.gz", gzip.compress(a) + bytes(packed) + gzip.compress(c), tmp_path)
    assert got[0] == whole[0] and got[-1][2] and got[-1][0] is None
    assert read_bytes("empty.warc", b"", tmp_path) == read_bytes("none.warc.gz", gzip.compress(b""), tmp_path) == read_bytes("junk.warc", b"no archive", tmp_path) == []
    assert read_bytes("short.warc", a + b"WARC/1.1\r\nContent-Le", tmp_path) == whole[:1]
