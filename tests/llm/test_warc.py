"""Archives read back whole, and what is recovered from damaged ones."""

import gzip
import hashlib
import random

import pytest
from llm_texts import lines, prose

from railweave.functions.runtime import scratch_path
from railweave.llm import warc

SCHEMA = "page_id long, url string, html string, key string, owner long, n string, member string, file string, kind string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, *("x",) * 4) for r in rows], SCHEMA)


def brute(rows):
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data, owner = (html or "").encode(), largest.get(html or "")
        again = len(data) >= 1000 and owner is not None and owner != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in warc.write_and_read(pages(spark, rows), **options).collect()), key=str)


BIG = lines(prose(41, 400))
ROWS = [
    (1, "http://a.example/x y", BIG), (2, "http://a.example/é\r\nX: 1", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000),
    (None, "u", BIG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (14, "u", "w" * 1500), (14, "u", "w" * 1500), (-5, "u", "w" * 1500),
    (20, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (21, "u", lines(prose(42, 60_000))), (22, "u", "\x00\x1f\x8b\x08 WARC/1.0\r\n" * 100),
]


def test_round_trip(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, ROWS, archive_bytes=3000) == brute(ROWS)


def test_most_pages_are_one_payload(spark):
    rows = [(k, "u", BIG if k % 3 else f"{BIG}{k}") for k in range(2000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_members_end_in_zero_and_are_plain_gzip(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 1000, 70_000, (1 << 24) + 5):
        data = rng.randbytes(n)
        packed = warc.member(data)
        assert packed[-1] == 0 and gzip.decompress(packed) == data


def archive(packed, n=12):
    """(bytes, list of (start, end, record id)) of an archive of n records."""
    out, places = b"", []
    for k in range(n):
        data = warc.record(k, f"http://a.example/{k}", lines(prose(k, 120)).encode(), None, False)
        data = warc.member(data) if packed else data
        places.append((len(out), len(out) + len(data), f"<urn:x-page:{k}>"))
        out += data
    return out, places


def found(data):
    parts = list(warc.salvage(data))
    return [h["warc-record-id"] for *_, h, _ in parts if h], [(s, s + n) for s, n, _, h, _ in parts if h is None], [r for *_, r, _, _ in parts if r]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive_has_no_gap(packed):
    data, places = archive(packed)
    assert found(data) == ([p[2] for p in places], [], [])


@pytest.mark.parametrize("packed", [True, False])
def test_one_damaged_byte_costs_one_record(packed):
    """Whatever byte is changed, all other records are recovered and the gap lies in the damaged one."""
    data, places = archive(packed)
    rng = random.Random(5)
    for _ in range(300):
        start, end, name = places[rng.randrange(len(places))]
        at = rng.randrange(start, end)
        ids, gaps, reasons = found(data[:at] + bytes([data[at] ^ (1 << rng.randrange(8))]) + data[at + 1:])
        missing = [p[2] for p in places if p[2] not in ids]
        if len(ids) == len(places):  # bytes that no check covers, such as a plain record's id or gzip's clock
            continue
        assert missing == [name] and reasons and all(start <= s and e <= end for s, e in gaps), (at, gaps)
        assert gaps == [(start, end)]


@pytest.mark.parametrize("packed", [True, False])
def test_cut_inserted_and_lost_bytes(packed):
    data, places = archive(packed)
    ids = [p[2] for p in places]
    third, fourth = places[3], places[4]
    cut = data[:places[-1][0] + 50]
    assert found(cut) == (ids[:-1], [(places[-1][0], len(cut))], found(cut)[2])
    junk = b"no record \x1f\x8b\x08 at all WARC/1.1\r\n" * 3
    assert found(data[:third[0]] + junk + data[third[0]:])[:2] == (ids, [(third[0], third[0] + len(junk))])
    lost = data[:third[0] + 40] + data[fourth[0] - 40:]
    assert found(lost)[0] == [i for i in ids if i != third[2]]
    assert found(junk) == ([], [(0, len(junk))], found(junk)[2]) and found(b"") == ([], [], [])


def test_every_byte_is_a_record_or_a_gap():
    rng = random.Random(9)
    for seed in range(60):
        data, _ = archive(seed % 2 == 0, 6)
        data = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            data[at:at + rng.randrange(1, 400)] = rng.randbytes(rng.randrange(0, 300))
        at = 0
        for start, length, *_ in warc.salvage(bytes(data)):
            assert start == at and length > 0
            at = start + length
        assert at == len(data)


def test_several_records_in_one_member():
    one, two, three = (warc.record(k, "u", lines(prose(k, 50)).encode(), None, False) for k in range(3))
    damaged = two.replace(b"sha1:", b"sha1:A", 2)
    ids, gaps, reasons = found(warc.member(one + damaged + three))
    assert ids == ["<urn:x-page:0>", "<urn:x-page:2>"] and len(gaps) == 1 and reasons == ["block digest"]


def test_reading_damaged_files(spark):
    """Gaps are logged with file, place and reason, beside the recovered records."""
    import os

    folder = scratch_path(spark, "damaged")
    os.makedirs(folder)
    data, places = archive(True, 200)
    plain, plain_places = archive(False, 100)
    bad = bytearray(data)
    bad[places[7][0] + 30] ^= 255
    bad[places[150][0] + 1] = 0
    for name, content in (("a.warc.gz", bytes(bad)), ("b.warc", plain[10:]), ("c.warc", b""), ("d.warc.gz", data[:-5])):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    rows = warc.read_archives(spark, folder).collect()
    by = {n: sorted((r.start for r in rows if r.file.endswith(n) and r.kind == "record")) for n in ("a.warc.gz", "b.warc", "c.warc", "d.warc.gz")}
    assert {k: len(v) for k, v in by.items()} == {"a.warc.gz": 198, "b.warc": 99, "c.warc": 0, "d.warc.gz": 199}
    gaps = sorted((r.file.rsplit("/", 1)[1], r.start, r.length) for r in rows if r.kind == "gap")
    assert gaps == [("a.warc.gz", places[7][0], places[7][1] - places[7][0]), ("a.warc.gz", places[150][0], places[150][1] - places[150][0]),
                    ("b.warc", 0, plain_places[0][1] - 10), ("d.warc.gz", places[199][0], places[199][1] - places[199][0] - 5)]
    assert all(r.reason for r in rows if r.kind == "gap") and all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in rows if r.kind == "record")
