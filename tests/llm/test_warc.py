import base64
import hashlib

import pytest

from wordloom.llm import warc
from wordloom.session import scratch_path

PAGES = [(3, "http://a/", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (2, None, ""), (9, "u", None), (4, "http://c/", "é" * 70_000),
         (5, "http://c/", "é" * 70_000), (5, "http://c/", "é" * 70_000), (6, "z", "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
         (None, "n", "<p>x</p>"), (None, None, "lone"), (None, None, "lone"), (7, "q", "short")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in PAGES], "page_id long, url string, html string, sha256 string, page int").repartition(3)


def brute(min_bytes=0):
    out, seen = [], {}
    order = sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or ""))
    for i, _, h in order:
        b = (h or "").encode()
        first = seen.setdefault(b, i) if b in seen or True else None
        fresh = not any(x[5] == b for x in out)
        response = fresh or len(b) < min_bytes
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit",
                    None if response else first, b))
    return sorted((x[:5] for x in out), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 6, 1000])
def test_brute_force(pages, min_bytes):
    got = warc.archive(pages, min_bytes=min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(min_bytes)


def test_records_are_restored_byte_for_byte(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/contents").count() == len({h or "" for _, _, h in PAGES})
    rows = warc.restore(spark, path).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"])
        payload = bytes(r["payload"])
        assert block == (payload if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert payload in {(h or "").encode() for i, _, h in PAGES if i == r["page_id"]}
        assert "X" not in fields


def test_a_damaged_payload_is_noticed(spark, pages):
    path, other = scratch_path(spark, "warc-test"), scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/contents").selectExpr("sha256", "cast(concat(cast(payload as string), '!') as binary) payload").write.parquet(f"{other}/contents")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_contents(spark, other).collect()


def test_empty(spark, pages):
    assert warc.archive(pages.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    ids = ["a:b>c", "", "null", "~", "é\r\n 1", "x%20y", None]
    rows = [(i, "u", "same") for i in ids]
    got = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).select("page_id", "record_type", "refers_to").collect()
    assert sorted((r["page_id"] for r in got), key=repr) == sorted(ids, key=repr)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(i, "revisit" if i != "" else "response", "" if i != "" else None) for i in ids}
    number = warc.archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id int, url string, html string"))
    assert dict(number.dtypes)["refers_to"] == "int" and {r["refers_to"] for r in number.collect()} == {None, 1}
