"""Operator 2: archives round-trip, equal payloads, salvage."""

import gzip
import random
import re
import time

import pytest
from dupescope.llm import common, warc

HTML = ["<p>a</p>", "<p>b é</p>", None, "", "<p>a</p>", "x" * 3000, "<p>a</p>"]


def made(n=6):
    return [warc.record_bytes(i, f"http://h/{i}", b"body %d" % i, warc.base32_sha1(b"body %d" % i), None) for i in range(n)]


def test_members_end_in_zero():
    for size in (0, 10, (16 << 20) + 5):
        assert warc.member_bytes(b"q" * size)[-1] == 0


def test_gzip_salvage_recovers_later_records():
    members = [gzip.compress(r, mtime=0) for r in made()]
    broken = bytearray(b"".join(members))
    begin = sum(map(len, members[:2]))
    for i in range(begin + 12, begin + 20):
        broken[i] ^= 0xFF
    found = warc.salvage(bytes(broken))
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 1, 3, 4, 5]
    assert [(b, e) for b, e, _ in found.gaps] == [(begin, begin + len(members[2]))]


def test_truncated_and_leading_rubbish():
    members = [gzip.compress(r, mtime=0) for r in made(3)]
    found = warc.salvage(b"rubbish" + b"".join(members)[:-9])
    assert [r.headers["warc-record-id"] for r in found.records] == ["<urn:x-page:0>", "<urn:x-page:1>"]
    assert found.gaps[0][:2] == (0, 7) and found.gaps[1][2] == "truncated member"


def test_plain_salvage():
    parts = made(4)
    bad = parts[1].replace(b"body 1", b"bodx 1")
    data = parts[0] + bad + parts[2] + b"junk" + parts[3]
    found = warc.salvage(data)
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 2, 3]
    a, b = len(parts[0]), len(parts[0]) + len(bad)
    assert found.gaps == [(a, b, "block digest differs"), (b + len(parts[2]), b + len(parts[2]) + 4, "no version line")]
    assert warc.salvage(b"").records == [] and warc.salvage(b"").gaps == []


def test_plain_salvage_behind_a_long_damaged_start():
    long = warc.record_bytes(9, "u", b"x" * 70_000, warc.base32_sha1(b"x" * 70_000), None)
    for begin in (b"XARC" + long[4:], b"rubbish " * 10_000):
        found = warc.salvage(begin + b"".join(made(3)))
        assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 1, 2]
        assert found.gaps == [(0, len(begin), "no version line")] and found.records[0].offset == len(begin)


def test_plain_records_between_members():
    parts = made(6)
    pieces = [gzip.compress(parts[0], mtime=0), parts[1], b"junk", parts[2], gzip.compress(parts[3], mtime=0)[:-9], parts[4], gzip.compress(parts[5], mtime=0)]
    found = warc.salvage(b"".join(pieces))
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 1, 2, 4, 5]
    places = [sum(map(len, pieces[:i])) for i in range(len(pieces) + 1)]
    assert [r.offset for r in found.records] == [places[i] for i in (0, 1, 3, 5, 6)]
    assert [(b, e) for b, e, _ in found.gaps] == [(places[2], places[3]), (places[4], places[5])]


def test_gzip_payload_of_a_damaged_record_is_no_member():
    zipped = gzip.compress(b"<p>page</p>", mtime=0)
    parts = [warc.record_bytes(i, "u", zipped, warc.base32_sha1(zipped), None) for i in range(3)]
    bad = parts[1].replace(b"Content-Type: text", b"Content-Type: tex_")
    found = warc.salvage(parts[0] + bad + parts[2])
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 2]
    assert found.gaps == [(len(parts[0]), len(parts[0]) + len(bad), "block digest differs")]


DAMAGE = {
    "line ends": lambda record: record.replace(b"\r\n", b"\n"),
    "no end of the header": lambda record: record.partition(warc.END)[0] + b"\r\n",
    "version lines alone": lambda record: b"WARC/1.1\r\n",
    "version lines without line ends": lambda record: b"WARC/1.1\n" + b"x" * 30,
    "a header line without colon or end": lambda record: b"WARC/1.1\r\nname " + b"y" * 300,
    "lengths too large": lambda record: record.replace(b"Content-Length: ", b"Content-Length: 9"),
    "magic numbers": lambda record: warc.GZIP + b"\x00" * 7 + b"\xff" * 20,
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_salvage_takes_linear_time(kind):
    """32 MB (8 of magic numbers, of which each is tried) of one kind of damage, with a sound record before, in and behind it."""
    sound, piece = made(3), DAMAGE[kind](made(1)[0])
    half = piece * (((4 if kind == "magic numbers" else 16) << 20) // len(piece))
    began = time.process_time()
    found = warc.salvage(sound[0] + half + sound[1] + half + sound[2])
    assert time.process_time() - began < 40
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0, 1, 2]
    a = len(sound[0])
    assert [(b, e) for b, e, _ in found.gaps] == [(a, a + len(half)), (a + len(half) + len(sound[1]), a + 2 * len(half) + len(sound[1]))]


@pytest.mark.parametrize("cut", [1, 60])
def test_salvage_of_cut_members_takes_linear_time(cut):
    rng, parts, size = random.Random(cut), [], 0
    while size < 16 << 20:
        body = b" ".join(b"%s%d" % (rng.choice((b"alpha", b"beta", b"<p>", b"</p>")), rng.randrange(1000)) for _ in range(rng.randint(50, 4000)))
        parts += [gzip.compress(warc.record_bytes(len(parts), "u", body, warc.base32_sha1(body), None), compresslevel=1, mtime=0)[:-cut]]
        size += len(parts[-1])
    sound = gzip.compress(made(1)[0], mtime=0)
    began = time.process_time()
    found = warc.salvage(b"".join(parts) + sound)
    assert time.process_time() - began < 40
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found.records] == [0] and [(b, e) for b, e, _ in found.gaps] == [(0, size)]


def test_an_archive_damaged_throughout(spark, tmp_path):
    (tmp_path / "d").mkdir()
    data = b"".join(made(40)).replace(b"\r\n", b"\n")
    (tmp_path / "d" / "a.warc").write_bytes(data)
    (tmp_path / "d" / "b.warc").write_bytes(b"")
    found = warc.read(spark, str(tmp_path / "d"))
    assert warc.records(found).count() == 0
    assert [(r.first_byte, r.end_byte, r.reason) for r in warc.quarantine(found).collect()] == [(0, len(data), "bad header line")]


def test_round_trip(spark, tmp_path):
    rows = [(i, None if i == 1 else f"http://h/{i}", h, 1) for i, h in enumerate(HTML)] + [(None, "u", "<p>a</p>", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op2_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 8
    for i, html in enumerate(HTML):
        payload = (html or "").encode()
        same = [j for j, h in enumerate(HTML) if (h or "") == (html or "")]
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == warc.base32_sha1(payload)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == max(same) else ("revisit", max(same)))
    assert got[None].record_type == "revisit" and got[None].refers_to == 6


def test_minimum_size_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), least_bytes=4)
    found = warc.read(spark, str(tmp_path / "w"), payloads=True)
    got = {r.page_id: r for r in warc.records(found).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    assert got[4].payload == b"abcdef" and got[3].payload is None
    assert warc.quarantine(found).count() == 0


def test_long_pages_repeated_rows_and_files_by_bytes(spark, tmp_path):
    rng = random.Random(2)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1 << 20))
    rows = [(i, "u", noise[i:] + noise[:i]) for i in range(6)]  # a megabyte each, hardly compressed
    rows += [(9, "u", "<p>" + noise * 18), (10, "u", "x" * (17 << 20)), (10, "u", "x" * (17 << 20)), (8, "v", "same"), (8, "w", "same"), (7, "v", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    warc.write(pages, str(tmp_path / "w"), piece_bytes=1 << 20, pieces_per_file=2)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 4 and sorted(sizes)[-2] < 4 << 20
    found = warc.read(spark, str(tmp_path / "w"))
    assert warc.quarantine(found).count() == 0
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found.collect())
    last = {h: max(i for i, _, g in rows if g == h) for _, _, h in rows}
    assert got == sorted((i, len(h), warc.base32_sha1(h.encode()), "response" if i == last[h] else "revisit", 0 if i == last[h] else last[h]) for i, _, h in rows)


def test_damaged_archives_are_read_through_spark(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}</p>" * 20) for i in range(50)], "page_id long, url string, html string").repartition(1)
    warc.write(pages, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = bytearray(file.read_bytes())
    at = [m.start() for m in re.finditer(re.escape(warc.GZIP), bytes(data))]
    for k in (3, 20):
        data[at[k] + 40] ^= 0xFF
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc.gz").write_bytes(data)
    found = warc.read(spark, str(tmp_path / "d"))
    order = [warc.page_of(r.headers["warc-record-id"]) for r in warc.salvage(file.read_bytes()).records]
    assert sorted(r.page_id for r in warc.records(found).collect()) == sorted(set(range(50)) - {order[3], order[20]})
    assert sorted((r.first_byte, r.end_byte) for r in warc.quarantine(found).collect()) == [(at[3], at[4]), (at[20], at[21])]


def test_an_archive_of_more_than_two_gigabytes(spark, tmp_path):
    (tmp_path / "a b%").mkdir()
    at, size = tmp_path / "a b%" / "large ä.warc", (2 << 30) + 12345
    first, last = made(2)
    with open(at, "wb") as f:  # sparse: all zeros but for a record at either end
        f.write(first)
        f.seek(size)
        f.write(last)
    found = warc.read(spark, str(tmp_path / "a b%"), payloads=True)
    assert sorted((r.page_id, r.offset, bytes(r.payload)) for r in warc.records(found).collect()) == [(0, 0, b"body 0"), (1, size, b"body 1")]
    assert [(r.first_byte, r.end_byte) for r in warc.quarantine(found).collect()] == [(len(first), size)]


def test_files_of_another_store_come_as_values(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(made(3)))
    batch = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").toArrow().to_batches()
    (out,) = warc.parse_batches(iter(batch), False)
    assert out.column("page_id").to_pylist() == [0, 1, 2]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text,words", [(None, []), ("", []), ("Ab\x0bÉ\x1fc d", [b"ab", "É\x1fc".encode(), b"d"])])
def test_words(text, words):
    assert common.lower_words(text) == words
