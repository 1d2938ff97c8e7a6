import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from lodestone.llm.warc import EITHER, Source, archive_files, archive_round_trip, gzip_member, page_digest, page_record, quarantined, read_archives, record, salvage, write_archives

DATE = "2020-01-01T00:00:00Z"


def pages(n=12):
    return [page_record(k, f"http://x.org/{k} \r\n", f"<p>page {k}</p>".encode() * (50 * k + 1), None, False, DATE) for k in range(n)]


def seen(data):
    """(ids read, gaps) of an archive's bytes."""
    rows, gaps, at = [], [], 0
    for place, length, records, why in salvage(Source(pa.BufferReader(data))):
        assert place == at and length > 0  # records and gaps cover the file
        at = place + length
        rows += [r["record_id"].split(":")[2] for r in records]
        if why:
            gaps.append((place, length, why))
    assert at == len(data)
    return rows, gaps


@pytest.mark.parametrize("pack", [lambda r: r, lambda r: gzip_member(r, 4)])
def test_salvage(pack):
    units = [pack(r) for r in pages()]
    every = [str(k) for k in range(12)]
    assert seen(b"".join(units)) == (every, [])
    assert seen(b"") == ([], [])
    at = sum(map(len, units[:5]))
    for place in (0, 3, len(units[5]) // 2, len(units[5]) - 3):  # a byte of the sixth record is wrong; plain headers have no checksum
        bad = bytearray(b"".join(units))
        bad[at + place] ^= 0x15
        rows, gaps = seen(bytes(bad))
        assert rows == every[:5] + every[6:] and [g[:2] for g in gaps] == [(at, len(units[5]))], (place, rows, gaps)
    whole = b"".join(units)
    assert seen(whole[: at + 40])[0] == every[:5] and seen(whole[: at + 40])[1][0][:2] == (at, 40)
    assert seen(whole[7:])[0] == every[1:]
    rows, gaps = seen(b"\x00" * 100 + whole + b"junk WARC/1.1\r\n \x1f\x8b\x08 junk")
    assert rows == every and gaps[0][:2] == (0, 100) and len(gaps) == 2
    lost = b"".join([*units[:3], units[3][:50], *units[6:9], units[9][60:], *units[10:]])
    rows, gaps = seen(lost)
    assert rows == ["0", "1", "2", "6", "7", "8", "10", "11"] and [g[1] for g in gaps] == [50, len(units[9]) - 60]


def test_wrong_length_doesnt_hide_later_records():
    r = pages(4)
    long = r[1].replace(b"Content-Length: ", b"Content-Length: 99999", 1)
    assert seen(r[0] + long + r[2] + r[3])[0] == ["0", "2", "3"]
    # the length reaches to the end of a later record: only the digest tells
    tail = len(r[1]) + len(r[2])
    head, _, rest = r[1].partition(b"\r\nContent-Length: ")
    wrong = head + b"\r\nContent-Length: " + str(int(rest.split(b"\r\n")[0]) + len(r[2])).encode() + rest[rest.index(b"\r\n") :]
    assert len(wrong) + len(r[2]) >= tail and seen(r[0] + wrong + r[2] + r[3])[0] == ["0", "2", "3"]


def test_false_beginnings_and_embedded_archives():
    inner = pages(2)[1]
    outer = page_record(7, None, inner + b"\x1f\x8b\x08\x00" + gzip_member(inner, 1), None, False, DATE)
    for pack in (lambda r: r, lambda r: gzip_member(r, 0)):  # level 0 stores bytes as they are
        assert seen(pack(outer) + pack(pages(1)[0]))[0] == ["7", "0"]
    assert EITHER.search(gzip_member(outer, 0)[3:])
    several = gzip.compress(b"".join(pages(3)))
    assert seen(several + gzip_member(pages(5)[4], 6))[0] == ["0", "1", "2", "4"]
    foreign = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:a:9:b>\r\n folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert seen(foreign) == (["9"], []) and seen(foreign.replace(b"abc", b"abcd"))[0] == []
    digest = base64.b32encode(hashlib.sha256(b"abc").digest()).decode()
    assert seen(foreign.replace(b"Content-Length", b"WARC-Block-Digest: sha256:" + digest.encode() + b"\r\nContent-Length"))[1] == []
    assert seen(record("warcinfo", "<urn:x:i:y>", DATE, b"", []))[0] == ["i"]


def slow(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == data]
        first = min(same) if same and len(data) >= least else None
        again = first is not None and (i is None or i > first)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


ROWS = [(5, "http://a/1", "<p>é 😀</p>"), (3, None, "<p>é 😀</p>"), (3, None, "<p>é 😀</p>"), (None, "http://a/\n x", "<p>é 😀</p>"), (4, "u", None), (2, "u", ""), (9, "", "WARC/1.1\r\n\r\n"), (10, "v", "x" * 3_000_000), (11, "v", "x" * 3_000_000), (None, "w", "alone")]
KEPT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, digest string, `key` int")
    for least in (0, 10):
        assert sorted(str(tuple(r[c] for c in KEPT)) for r in archive_round_trip(df, least=least).collect()) == slow(ROWS, least)
    assert archive_round_trip(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b:1 %", "u", "t"), ("a/é", "u", "t")], "name string, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in archive_round_trip(named, "name").collect()} == {"a/é": None, "b:1 %": "a/é"}


def test_damaged_files_on_spark(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k}</p>" * 500) for k in range(400)], "page_id long, url string, html string").repartition(2)
    for level in (4, 0):
        folder = str(tmp_path / f"w{level}")
        manifest = write_archives(df, level=level, target_bytes=1 << 15, folder=folder)
        assert sum(r["records"] for r in manifest.collect()) == 400 and manifest.count() > 3
        assert {r["path"].removeprefix("file:") for r in archive_files(spark, folder).collect()} == {r["path"] for r in manifest.collect()}
        whole = read_archives(manifest)
        assert quarantined(whole).count() == 0 and {bytes(r["payload"]).decode() for r in whole.where("type = 'response'").collect()} == {f"<p>{k}</p>" * 500 for k in range(400)}
        name = manifest.first()["path"]
        with open(name, "r+b") as f:
            data = f.read()
            f.seek(len(data) // 2)
            f.write(b"\x00" * 8)
        again = read_archives(archive_files(spark, folder), payloads=False)
        gaps = quarantined(again).collect()
        assert len(gaps) == 1 and gaps[0]["file"].endswith(name) and gaps[0]["offset"] <= len(data) // 2 < gaps[0]["offset"] + gaps[0]["length"]
        assert page_digest(again).count() == 399


def test_a_failed_digest_is_told(tmp_path):
    r = pages(1)[0].replace(b"page 0", b"page 1")
    assert seen(r)[1][0][2] == "block digest"
