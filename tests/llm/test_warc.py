"""WARC archives: round trip, damage of every kind, and the bytes that are left over."""

import gzip
import random

import pytest

from gaugeworks.llm import warc

SCHEMA = "page_id long, url string, html string"


def payload(i: int) -> bytes:
    return f"<html>page {i} {'x' * (i % 7)}</html>".encode()


def record(i: int) -> bytes:
    return warc.record_bytes(str(i), f"http://h/{i}", payload(i), None)


def ids(items) -> list[str]:
    return [r.headers["x-page-id"] for r in items if isinstance(r, warc.Record)]


def gaps(items) -> list[tuple[int, int]]:
    return [(g.start, g.end) for g in items if isinstance(g, warc.Gap)]


@pytest.mark.parametrize("wrap", [bytes, warc.member], ids=["plain", "members"])
def test_whole_archive(wrap):
    items = list(warc.scan(b"".join(wrap(record(i)) for i in range(20))))
    assert ids(items) == [str(i) for i in range(20)] and not gaps(items)
    assert [r.payload for r in items] == [payload(i) for i in range(20)]


@pytest.mark.parametrize("wrap", [bytes, warc.member], ids=["plain", "members"])
@pytest.mark.parametrize("seed", range(12))
def test_one_damaged_byte_loses_one_record(wrap, seed):
    """Whatever byte is changed, all other records come back, and records and gaps cover every byte."""
    pieces = [wrap(record(i)) for i in range(8)]
    place = random.Random(seed)
    hurt = place.randrange(8)
    broken = bytearray(pieces[hurt])
    broken[place.randrange(len(broken))] ^= 1 << place.randrange(8)
    data = b"".join([*pieces[:hurt], bytes(broken), *pieces[hurt + 1 :]])
    items = list(warc.scan(data))
    whole = [r for r in items if isinstance(r, warc.Record)]
    assert {str(i) for i in range(8) if i != hurt} <= set(ids(items))
    assert all(r.payload == payload(int(r.headers["x-page-id"])) for r in whole if r.headers.get("x-page-id", "").isdigit() and r.headers["x-page-id"] != str(hurt))
    covered = sorted({(i.start, i.end) for i in items})
    assert covered[0][0] == 0 and covered[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


@pytest.mark.parametrize("wrap", [bytes, warc.member], ids=["plain", "members"])
def test_cut_short_missing_and_foreign_bytes(wrap):
    pieces = [wrap(record(i)) for i in range(5)]
    start = len(pieces[0])
    # the middle of record 1 is missing: its rest is a gap, record 2 follows it
    items = list(warc.scan(pieces[0] + pieces[1][: len(pieces[1]) // 2] + b"".join(pieces[2:])))
    assert ids(items) == ["0", "2", "3", "4"] and gaps(items) == [(start, start + len(pieces[1]) // 2)]
    # the end is missing
    items = list(warc.scan(pieces[0] + pieces[1][:-9]))
    assert ids(items) == ["0"] and gaps(items) == [(start, start + len(pieces[1]) - 9)]
    # foreign bytes before, between and behind, with false signs of members and records
    junk = b"\x1f\x8b\x08 WARC/1.0\r\nno header \x1f\x8b\x08\x00"
    items = list(warc.scan(junk + pieces[0] + junk + pieces[1] + junk))
    n = len(junk)
    assert ids(items) == ["0", "1"]
    assert gaps(items) == [(0, n), (n + start, 2 * n + start), (2 * n + start + len(pieces[1]), 3 * n + start + len(pieces[1]))]


def test_one_gzip_stream_over_many_records():
    whole = b"".join(record(i) for i in range(6))
    hurt = bytearray(whole)
    hurt[len(record(0)) + len(record(1)) - 12] ^= 1
    items = list(warc.scan(gzip.compress(bytes(hurt))))
    assert ids(items) == ["0", "2", "3", "4", "5"]
    assert len(gaps(items)) == 1 and "of the content" in items[1].reason


@pytest.mark.parametrize(
    "change, reason",
    [
        ((b"WARC/1.1", b"WARC/9.1"), "version line"),
        ((b"Content-Length: ", b"Content-Length: x"), "content length"),
        ((b"WARC-Type: ", b"WARC-Type "), "header line"),
        ((b"page 3", b"page 4"), "block digest"),
        ((b"\r\n\r\n<html>", b"\r\n\r\n<htmls>"), "end of record"),
    ],
)
def test_reasons(change, reason):
    items = list(warc.scan(record(1) + record(3).replace(*change) + record(5)))
    assert ids(items) == ["1", "5"] and [g.reason for g in items if isinstance(g, warc.Gap)] == [reason]


def test_empty_input_is_no_record():
    assert list(warc.scan(b"")) == [] and gaps(warc.scan(b"\0" * 50)) == [(0, 50)]


def test_large_member_ends_in_zero():
    noise = random.Random(3).randbytes((1 << 24) + 5)
    made = warc.record_bytes("1", None, noise, None)
    packed = warc.member(made)
    assert packed.endswith(b"\0") and gzip.decompress(packed) == made
    items = list(warc.scan(packed + warc.member(record(2))))
    assert ids(items) == ["1", "2"] and items[0].payload == noise


def expected(rows):
    """Brute force over (page_id, url, html) rows."""
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        last = max(same) if same else None
        kind = "response" if page == last else "revisit"
        out.append((page, len(body), warc.base32_sha1(body), kind, last if kind == "revisit" else None))
    return sorted(out, key=str)


CASES = [
    (1, "http://a/", "same"),
    (5, "http://b/", "same"),
    (3, None, "same"),
    (5, "http://b/", "same"),
    (None, "http://c/ d\r\nX: y", "same"),
    (7, "http://d/", ""),
    (8, "http://e/", None),
    (None, None, "only without id"),
    (9, "http://f/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08 ü 漢\0"),
    (10, "http://g/", "long " * 300_000),
    (11, "", "x"),
]


def test_round_trip_in_spark(spark, rows):
    pages = spark.createDataFrame(CASES, SCHEMA).selectExpr("*", "'z' as payload", "1 as refers_to", "2 as record_type")
    got = warc.round_trip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert [tuple(r) for r in sorted(got.collect(), key=lambda r: str(tuple(r)))] == expected(CASES)


def test_least_payload_leaves_small_ones_whole(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer text"), (4, "u", "longer text")], SCHEMA)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, least_payload=5)
    found = warc.read_archives(spark, path)
    kinds = {r["page_id"]: (r["record_type"], r["payload"] and bytes(r["payload"])) for r in found.collect()}
    assert kinds == {"1": ("response", b"abc"), "2": ("response", b"abc"), "3": ("revisit", None), "4": ("response", b"longer text")}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_members_and_damage_is_logged(spark, tmp_path):
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat('<p>', id) as html")
    path = tmp_path / "archive"
    warc.write_archives(pages.coalesce(1), str(path))
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    assert data.startswith(warc.GZIP_START) and gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    hurt = tmp_path / "hurt"
    hurt.mkdir()
    start = data.index(warc.GZIP_START, 1)
    end = data.index(warc.GZIP_START, start + 1)
    (hurt / "a").write_bytes(data[: start + 40] + b"??" + data[start + 42 :])
    found = warc.read_archives(spark, str(hurt))
    assert warc.page_records(found).count() == 39
    assert [(r["start"], r["end"]) for r in warc.gaps(found).collect()] == [(start, end)]


def test_revisit_of_a_lost_response_refers_to_nothing(spark, tmp_path):
    lost = warc.record_bytes("2", "http://h/", b"same", None)
    kept = warc.member(warc.record_bytes("1", "http://h/", b"same", "2"))
    (tmp_path / "a").write_bytes(warc.member(lost)[:-20] + kept)
    found = warc.read_archives(spark, str(tmp_path))
    digest = warc.base32_sha1(b"same")
    assert [tuple(r) for r in warc.page_records(found).collect()] == [("1", 4, digest, "revisit", None)]


def test_registered_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = entry.queries()["op11_warc"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(pages)
