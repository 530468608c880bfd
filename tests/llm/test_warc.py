import base64
import gzip
import hashlib

import pytest

from corpuslink.llm import warc as W

PAGES = [(1, "http://a/x y\r\n", "<p>é</p>"), (0, "u", "<p>é</p>"), (2, None, None), (3, "", ""), (4, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: x"), (5, "u", "x" * 300_000), (0, "u", "<p>é</p>"), (None, "n", "<p>é</p>")]


def frame(spark):
    return spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int")


def test_round_trip(spark):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.round_trip(frame(spark)).collect())
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw, revisit = (h or "").encode(), i is not None and i > first[h or ""]
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want)


def test_least_size(spark):
    kinds = {r.page_id: r.record_type for r in W.round_trip(frame(spark), 100).collect()}
    assert set(kinds.values()) == {"response"}


def test_empty(spark):
    assert W.round_trip(frame(spark).where("false")).count() == 0


def records(spark):
    return [r.record.encode() + b"\r\n\r\n" for r in W.records(frame(spark)).collect()]


def test_salvage(spark):
    parts = records(spark)
    plain, packed = b"".join(parts), b"".join(map(gzip.compress, parts))
    for data in (plain, packed, plain + packed):
        found, gaps = W.salvage(data)
        assert len(found) % len(parts) == 0 and found and not gaps
    for data, sizes in ((plain, [len(p) for p in parts]), (packed, [len(gzip.compress(p)) for p in parts])):
        for k in range(len(parts)):
            at = sum(sizes[:k])
            bad = bytearray(data)
            bad[at : at + 12] = b"x" * 12
            found, gaps = W.salvage(bytes(bad))
            assert len(found) == len(parts) - 1
            assert (gaps[0][0], gaps[-1][1]) == (at, at + sizes[k])
    found, gaps = W.salvage(plain[:-40] + packed + b"junk")
    assert len(found) == 2 * len(parts) - 1 and len(gaps) == 2
    assert W.salvage(b"") == ([], []) and W.salvage(b"junk")[1] == [(0, 4, "neither a record nor a member")]


def test_wrong_payload_is_quarantined(spark):
    parts = records(spark)
    k = next(i for i, p in enumerate(parts) if b"<p>" in p and b"Type: response" in p)
    bad = [p.replace(b"<p>", b"<q>") if i == k else p for i, p in enumerate(parts)]
    found, gaps = W.salvage(b"".join(bad))
    assert len(found) == len(parts) - 1 and gaps[0][2] == "the payload has another digest"


def test_names_of_headers_in_any_case(spark):
    parts = [p.replace(b"WARC-Type", b"warc-TYPE", 1).replace(b"Content-Length: ", b"content-length:", 1) for p in records(spark)]
    found, gaps = W.salvage(b"".join(parts))
    assert len(found) == len(parts) and not gaps


def test_a_record_within_a_broken_one_is_read(spark):
    inner = records(spark)[0]
    outer = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    assert [len(x) for x in W.salvage(outer)] == [1, 0]
    found, gaps = W.salvage(outer.replace(b"<urn:x>\r\nContent-Length", b"<urn:x>\r\nContent-Lengt"))
    assert len(found) == 1 and found[0].headers["warc-record-id"] != "<urn:x>" and [g[2] for g in gaps] == ["a header is missing", "neither a record nor a member"]


def test_gaps_are_logged_and_fail(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    n = W.write_archives(frame(spark).coalesce(1), path, size=1)
    assert n == len(PAGES) and len(list((tmp_path / "a").glob("part-*"))) == n
    for f in sorted((tmp_path / "a").glob("part-*"))[:2]:
        f.with_name(f".{f.name}.crc").unlink()  # of the file system, which would stop the reading
        f.write_bytes(b"x" + f.read_bytes()[1:])
    rows = W.read_archives(spark, path).collect()
    assert sum(r.gap for r in rows) == 2 and sum(not r.gap for r in rows) == n - 2
    write = W.write_archives
    monkeypatch.setattr(W, "write_archives", lambda *a: write(*a) + 1)
    with pytest.raises(RuntimeError, match="8 of 9 records"):
        W.round_trip(frame(spark))


def test_long_and_null_payloads(spark):
    pages = spark.createDataFrame([(i, "u", None if i < 300 else "y" * 3_000_000) for i in range(302)], "page_id long, url string, html string")
    got = W.round_trip(pages).collect()
    assert sum(r.record_type == "revisit" for r in got) == 300 and {r.refers_to for r in got} == {None, 0, 300}
