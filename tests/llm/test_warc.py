"""Archives: an exact round trip, push-down, skipping, foreign files and odd rows."""

import base64
import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import warc

PAGES = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>two é 漢</p>"), (3, None, "<p>one</p>"), (4, "http://a.example/\r\nX: 1", ""), (5, "u", None), (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (None, "u", "<p>one</p>"), (None, "v", "alone"), (9, "u", "<p>nine</p>"), (9, "u", "<p>nine</p>"),
]


def plain(pages, least=0):
    top = {}
    for i, _, html in pages:
        top.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [x for x in top[html or ""] if x is not None]
        keeper = max(same) if same and len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keeper == i else "revisit", None if keeper == i else keeper))
    return sorted(out, key=repr)


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)


@pytest.mark.parametrize("least", [0, 5, 1_000])
def test_round_trip(spark, least):
    got = warc.round_trip(table(spark), min_bytes=least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(PAGES, least)
    assert warc.round_trip(table(spark, []), min_bytes=least).count() == 0


@pytest.fixture(scope="module", params=["gzip", "none"])
def archive(request, spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/{request.param}"
    warc.write_warc(warc.records(table(spark)), path, compression=request.param, file_bytes=2_000)
    return path


def test_payloads_and_headers(spark, archive):
    rows = {(r.record_id, r.warc_type): r for r in warc.read_warc(spark, archive).collect()}
    assert rows["urn:page:7", "revisit"].payload == b"" and rows["urn:page:7", "revisit"].payload_bytes == 300_000 and rows["urn:page:7", "revisit"].refers_to == "urn:page:8"
    assert rows["urn:page:8", "response"].payload == b"x" * 300_000 and rows["urn:page:8", "response"].http_status == 200
    assert rows["urn:page:6", "response"].payload.decode() == PAGES[5][2]
    assert rows["urn:page:4", "revisit"].target_uri == "http://a.example/%0D%0AX:%201" and rows["urn:page:3", "response"].target_uri is None
    assert rows["urn:page:2", "response"].headers["WARC-Payload-Digest"] == "sha1:" + rows["urn:page:2", "response"].payload_digest
    assert os.path.basename(archive) != "gzip" or len({r.file for r in rows.values()}) > 1


def test_push_down(spark, archive):
    heads = lambda *c: warc.read_warc(spark, archive, *c, push=True)
    some = heads("record_id", "warc_type", "content_length").where((F.col("warc_type") == "revisit") & F.col("record_id").startswith("urn:page:7") & (F.col("content_length") > 5))
    assert [r.record_id for r in some.collect()] == ["urn:page:7"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(\) |- |^)Filter ", plan), plan  # nothing is left for Spark to test
    assert heads("warc_type").where("warc_type = 'revisit'").count() == sum(x[3] == "revisit" for x in plain(PAGES))
    assert heads("warc_type", "record_id").where("record_id in ('urn:page:1', 'urn:page:2') or warc_type = 'none'").count() == 2
    assert heads("record_id").where("record_id > 'urn:page:5'").count() == 5  # strings compare by bytes: left to Spark
    assert heads("refers_to").where("refers_to is null").count() + heads("refers_to").where("refers_to is not null").count() == len(PAGES)


def test_stated_predicates(spark, archive):
    some = warc.read_warc(spark, archive, "record_id", where={"warc_type": ["revisit", "metadata"], "refers_to": "urn:page:3"})
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:", "urn:page:1"]
    # one load may serve several branches
    both = some.where("record_id = 'urn:page:1'").union(some.where("record_id <> 'urn:page:1'"))
    assert both.count() == 2
    assert warc.read_warc(spark, archive, "record_id", where={"target_uri": None}).count() == 1
    with pytest.raises(Exception, match="no header column"):
        warc.read_warc(spark, archive, "record_id", where={"payload": "x"}).collect()


def test_bodies_are_passed_over(archive):
    """Reading heads alone touches a small part of the files."""

    class Counted:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.bytes += n
            return self.file.read_at(n, at)

    def bytes_read(*columns):
        reader, total = warc.WarcReader({"path": archive}, list(columns)), 0
        files, _ = warc._file_system(archive)
        for part in reader.partitions():
            for path in part.paths:
                with files.open_input_file(path) as file:
                    counted = Counted(file)
                    list(reader.records((warc._Gzip if path.endswith(".gz") else warc._Plain)(counted, path)))
                    total += counted.bytes
        return total

    if archive.endswith("none"):
        assert bytes_read("record_id") < 200_000 < bytes_read("payload")
    assert len(warc.WarcReader({"path": archive, "split_bytes": "1"}, ["record_id"]).partitions()) > 1


def test_compressed_members_are_not_inflated(tmp_path):
    data = [warc.member(warc.record({"warc_type": "response", "record_id": f"urn:{k}", "target_uri": None, "payload": os.urandom(200_000), "payload_bytes": 200_000, "payload_digest": "A", "refers_to": None}, "d")) for k in range(5)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(data))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == 5
    fills = []
    with warc.fs.LocalFileSystem().open_input_file(str(path)) as file:
        source = warc._Gzip(file, "a")
        real = source.fill
        source.fill = lambda: (fills.append(1), real())[1]
        reader = warc.WarcReader({"path": str(path)}, ["record_id"])
        assert [r["record_id"] for r in reader.records(source)] == [f"urn:{k}" for k in range(5)]
    assert len(fills) <= 6


def test_foreign_and_broken_files(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"WARC/1.0\r\nwarc-type: resource\r\nwarc-record-id: <urn:r>\r\ncontent-type: text/plain\r\ncontent-length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "good").mkdir()
    (tmp_path / "good/plain.warc").write_bytes(text)
    (tmp_path / "good/whole.warc.gz").write_bytes(gzip.compress(text))  # one member for all records
    (tmp_path / "good/notes.txt").write_bytes(b"no archive")
    rows = warc.read_warc(spark, f"file://{tmp_path}/good").orderBy("record_id", "file").collect()
    assert [(r.record_id, r.payload, r.payload_bytes, r.http_status) for r in rows] == [("urn:i", b"abc", 3, None)] * 2 + [("urn:r", b"hi", 2, None)] * 2
    assert rows[0].headers["X-Long"] == "a b"
    assert warc.read_warc(spark, f"file://{tmp_path}/good", "record_id").where("record_id = 'urn:r'").count() == 2
    for name, broken in (("cut.warc", text[:-8]), ("foreign.warc", b"hello\r\n\r\n"), ("cut.warc.gz", gzip.compress(text)[:-20])):
        (tmp_path / name).write_bytes(broken)
        with pytest.raises(Exception, match=name):
            warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("warc").schema("nothing int").load(f"file://{tmp_path}/good").collect()
