"""Archives: exact round trips, what other readers see, and damaged archives."""

import glob
import hashlib

import pytest
import zstandard

from strandframe.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, error int"
PAGE = "<html><body>" + "the same words of a page, again and again. " * 20


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://example.org/{i}?q=ü y\r\n", f"{PAGE}{i}</html>") for i in range(60)]
    rows += [(100 + i, None, PAGE) for i in range(40)]
    rows += [(200, "", None), (201, "u", ""), (202, "u", "a" * 99), (203, "u", "a" * 99), (204, "u", "a" * 100), (205, "u", "a" * 100), (206, "u", "ü" * 50)]
    rows += [(99, "u", PAGE), (99, "u", PAGE), (None, "u", PAGE), (None, None, None), (300, "u", warc.EMPTY_FRAME * 2000), (301, "u", "日本 \r\n\r\n WARC/1.1 " + "x" * 3_000_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def test_report(spark, pages):
    got = [tuple(r) for r in warc.archive_report(frame(spark, pages)).collect()]
    assert sorted(got, key=repr) == sorted(expected(pages), key=repr)
    assert warc.archive_report(frame(spark, [])).collect() == []


def test_hot_payload(spark, monkeypatch):
    """Payloads that are too frequent for the join are broadcast, with the same rows."""
    monkeypatch.setattr(warc, "HOT_PART", 10)
    rows = [(i, "u", PAGE if i % 3 else f"{PAGE}{i // 6}") for i in range(90)]
    assert sorted(map(tuple, warc.archive_report(frame(spark, rows)).collect())) == sorted(expected(rows))


def test_archives(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(frame(spark, pages), path, archive_bytes=2000)
    files = glob.glob(f"{path}/part-*")
    assert len(files) > 3
    back = {r["page_id"]: r for r in warc.read_archives(spark, path, "long").collect()}
    for i, url, html in pages:
        if i is None:  # two rows have none
            continue
        r = back[i]
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (html or "")
        assert r["url"] is None if not url else "\n" not in r["url"]
    # Another decoder: the dictionary is the first frame's, the rest is a stream of frames.
    data = open(max(files, key=lambda f: len(open(f, "rb").read())), "rb").read()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    stream = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[8 + size :], read_across_frames=True)
    text = stream.read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == sum(1 for _ in warc.records_of(data))


def test_foreign_archives():
    """Without a dictionary, with a plain one, without sizes or checksums, with other records and continued headers."""
    one = warc.record_bytes("7", "http://x", hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: d\r\nsoftware: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    plain = zstandard.ZstdCompressor(write_content_size=False).compress
    parts = [r for _, r in warc.records_of(plain(info) + plain(one) + warc.EMPTY_FRAME.encode())]
    assert parts == [info, one]
    rows = [warc.parsed(p) for p in parts]
    assert rows[0]["payload"] == b"hello" and rows[0]["page_id"] is None and rows[1]["page_id"] == "7" and rows[1]["payload"] == b"abc"
    raw = b"words of a dictionary that is only text " * 30
    data = warc.struct.pack("<II", warc.DICTIONARY_FRAME, len(packed := zstandard.ZstdCompressor().compress(raw))) + packed
    data += zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(one)
    assert [r for _, r in warc.records_of(data)] == [one]
    big = zstandard.ZstdCompressor().compress(bytes(range(256)) * 5000) + zstandard.ZstdCompressor().compress(b"") + zstandard.ZstdCompressor().compress(b"\0" * 900_000)
    assert [len(r) for _, r in warc.records_of(big)] == [1_280_000, 0, 900_000]
    assert list(warc.records_of(b"")) == []


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda r: r.replace(b"Content-Length: 8", b"Content-Length: 7", 1), "Content-Length"),
        (lambda r: r.replace(b"sha256:", b"sha256:0"), "digest"),
        (lambda r: r.replace(b"WARC-Date", b"X-Date"), "missing warc-date"),
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.1"), "not a record"),
        (lambda r: r.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), "digest"),
        (lambda r: r.replace(b"Content-Type: app", b"Content-Type app"), "not a header"),
        (lambda r: r[:-1], "Content-Length"),
        (lambda r: r.replace(b"Length: 3", b"Length: 2"), "HTTP"),
        (lambda r: r.replace(b"HTTP/1.1 200", b"XTTP/1.1 200"), "HTTP"),
    ],
)
def test_bad_records(change, said):
    good = warc.record_bytes("7", "http://x", hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    warc.parsed(good)
    assert change(good) != good
    with pytest.raises(ValueError, match=said):
        warc.parsed(change(good))


def test_damaged_archives(spark, tmp_path):
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    good = [pack(warc.record_bytes(str(i), "u", hashlib.sha256(b"abc").hexdigest(), 3, b"abc")) for i in range(4)]
    flipped = bytearray(good[1])
    flipped[-1] ^= 1  # the checksum
    (tmp_path / "a.zst").write_bytes(good[0] + bytes(flipped) + good[2])
    (tmp_path / "b.zst").write_bytes(good[3][:-9])
    (tmp_path / "c.zst").write_bytes(good[3] + b"junk")
    rows = warc.read_archives(spark, str(tmp_path), on_error="keep").collect()
    assert sorted(r["page_id"] for r in rows if not r["error"]) == ["0", "2", "3"]
    assert sum(r["error"] is not None for r in rows) == 3 and all(r["page_id"] is None for r in rows if r["error"])
    with pytest.raises(Exception, match="byte "):
        warc.read_archives(spark, str(tmp_path)).collect()
