import hashlib

import pytest

from quadlake.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def back(spark, df, path, **options):
    warc.write(df, str(path), **options)
    return {(r["key"], r["warc_type"]): r for r in warc.reassemble(warc.read_records(spark, str(path))).collect()}


def test_round_trip_with_segments(spark, tmp_path):
    texts = ["", "x", "ü" * 700, "WARC/1.0\r\n\r\n0\r\n\r\n" * 30, "b" * 5000, None, "\r\n\r\n"]
    got = back(spark, pages(spark, [(i, f"http://x/{i}\r\nX: y", t) for i, t in enumerate(texts)]), tmp_path / "a", segment_bytes=97, chunk_bytes=13)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[str(i), "response"]
        assert bytes(r["payload"]) == (t or "").encode() and r["status"] == "ok" and r["digest"] == hashlib.sha1((t or "").encode()).hexdigest()
        assert r["target_uri"] == f"http://x/{i}  X: y"


def test_revisits(spark, tmp_path):
    rows = [(1, "u", "a" * 1000), (3, "u", "a" * 1000), (2, "v", "a" * 1000), (4, "u", "a" * 999), (5, "u", "a" * 999), (None, None, "a" * 1000), (3, "u", "a" * 1000)]
    warc.write(pages(spark, rows), str(tmp_path / "a"))
    got = sorted((r["key"] or "", r["warc_type"], r["refers_key"]) for r in warc.reassemble(warc.read_records(spark, str(tmp_path / "a"))).collect())
    assert got == [("", "revisit", "3"), ("1", "revisit", "3"), ("2", "revisit", "3"), ("3", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None)]


def test_empty_table(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "a"))
    assert warc.reassemble(warc.read_records(spark, str(tmp_path / "a"))).count() == 0


BODY = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"


@pytest.mark.parametrize(
    ("parts", "total", "status"),
    [
        ([(1, BODY[:20]), (2, BODY[20:])], len(BODY), "ok"),
        ([(2, BODY[20:]), (1, BODY[:20]), (2, BODY[20:])], len(BODY), "ok"),
        ([(1, BODY[:20]), (3, BODY[20:])], len(BODY), "missing segment"),
        ([(2, BODY[20:])], len(BODY), "no first segment"),
        ([(1, BODY[:20]), (2, BODY[20:])], len(BODY) + 1, "wrong length"),
        ([(1, BODY[:20]), (2, BODY[20:]), (2, b"zz")], len(BODY), "conflicting segments"),
        ([(1, BODY[:20])], None, "missing segment"),
        ([(1, BODY[:20]), (2, BODY[20:-9])], len(BODY) - 9, "broken chunk"),
    ],
)
def test_reassembly(spark, parts, total, status):
    rows = [(f"r{n}", "response" if n == 1 else "continuation", "7" if n == 1 else None, None, None, None, n, None if n == 1 else "r1", total if n > 1 else None, bytearray(b)) for n, b in parts]
    (r,) = warc.reassemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()
    assert r["status"] == status and (bytes(r["payload"]) == b"abc" if status == "ok" else r["payload"] is None)


def test_parser_marks_a_cut(spark):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[-1] for r in warc.parse(record * 2 + record[:-7])] == [b"hello", b"hello", None]
    assert [(r[1], r[-1]) for r in warc.parse(record + record[:35])] == [("response", b"hello"), ("response", None)]
    rows = [("r1", "response", "1", None, None, None, None, None, None, None), ("r2", "response", "2", None, None, None, 1, None, None, bytearray(BODY[:20])), ("r3", "continuation", None, None, None, None, 2, "r2", len(BODY), None)]
    got = warc.reassemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()
    assert {(r["key"], r["status"], r["payload"]) for r in got} == {("1", "truncated", None), ("2", "truncated", None)}
    assert warc.dechunk(b"HTTP/1.1 200 OK\r\n\r\nplain") == (b"plain", "ok")
