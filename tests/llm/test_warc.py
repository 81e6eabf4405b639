"""WARC archives: what is written, read back, against a brute force; odd payloads and rows."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wirelens.llm import warc

LONG = "<html>" + "a long payload " * 10
PAYLOADS = [
    None, "", "x", "é" * 49, "é" * 50, "é" * 50, LONG, LONG, LONG, LONG + "\r\n", LONG + "\r\n", LONG + "\r\n\r\n",
    "\r\n\r\n" + LONG, "\r\n" * 60, "\r\n" * 60, "\r" * 120, "\n\r\n\r" * 30, LONG + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfake!\r\n\r\n",
    "WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + LONG, "\U0001f600" * 40, "\x00" * 130, "﻿" + LONG,
]


def brute(rows):
    """{(page_id, payload): (bytes, digest, type, refers_to)}"""
    least = {}
    for page, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    found = {}
    for page, html in rows:
        data = (html or "").encode()
        first = least.get(html or "") if len(data) >= 100 else None
        again = first is not None and first != page
        found[page, html or ""] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
    return found


def round_trip(spark, tmp_path, rows, config=warc.Settings(), kind="long"):
    pages = spark.createDataFrame([(p, f"http://a.b/{p}\r\nX: y", h, "x", 1) for p, h in rows],
                                  f"page_id {kind}, url string, html string, payload string, size int")
    path = str(tmp_path / "warc")
    warc.write(pages.repartition(3), path, config)
    return path, warc.read(spark, path, kind).collect()


def test_round_trip(spark, tmp_path):
    rows = list(enumerate(PAYLOADS)) + [(1000 + i, h) for i, h in enumerate(PAYLOADS)] + [(None, LONG), (None, "only here " * 20)]
    path, got = round_trip(spark, tmp_path, rows)
    want = brute(rows)
    assert len(got) == len(rows)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): h or "" for h in PAYLOADS + ["only here " * 20]}
    for r in got:
        text = texts[r.payload_digest]
        assert want[r.page_id, text] == (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        if r.record_type == "response":
            assert r.intact and bytes(r.payload).decode() == text and r.refers_to_id is None
        else:
            assert r.payload is None and r.intact is None
        assert r.uri == f"http://a.b/{r.page_id}%0D%0AX:%20y"
    ids = {r.page_id: r.record_id for r in got}
    assert all(r.refers_to_id == ids[r.refers_to] for r in got if r.record_type == "revisit")
    assert len({r.record_id for r in got if r.page_id is not None}) == len(rows) - 2


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_payload(spark, tmp_path, hot):
    """A payload that half of all rows hold is looked up by broadcast, the others by digest."""
    draw = random.Random(4)
    rows = [(i * 7 % 1009, LONG if draw.random() < 0.5 else f"{draw.randrange(60)} " * 60) for i in range(800)]
    _, got = round_trip(spark, tmp_path, rows, warc.Settings(hot_digests=hot, records_per_file=50))
    want = brute(rows)
    texts = {hashlib.sha256(h.encode()).hexdigest(): h for _, h in rows}
    assert {(r.page_id, texts[r.payload_digest]): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_odd_rows(spark, tmp_path):
    # rows that repeat the least id are responses, a repeated later id is a revisit each time
    rows = [(1, LONG), (1, LONG), (2, LONG), (2, LONG), (2, "other " * 30)]
    _, got = round_trip(spark, tmp_path / "a", rows)
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [
        (1, "response", 0), (1, "response", 0), (2, "response", 0), (2, "revisit", 1), (2, "revisit", 1)]
    _, got = round_trip(spark, tmp_path / "b", [("é b", LONG), ("z\r\n", LONG)], kind="string")
    assert sorted((r.page_id, r.refers_to) for r in got) == [("z\r\n", None), ("é b", "z\r\n")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def test_long_payload(spark, tmp_path):
    text = "line one\r\n\r\nline two " * 300_000  # 6 MB of short pieces
    _, got = round_trip(spark, tmp_path, [(1, text), (2, text), (3, "x" + text)])
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == [
        (1, "response", len(text)), (2, "revisit", len(text)), (3, "response", len(text) + 1)]


def test_layout_of_the_archive(spark, tmp_path):
    """Read by a plain reader that knows the format and nothing of the writer."""
    path, _ = round_trip(spark, tmp_path, [(1, LONG), (2, LONG), (3, "")], warc.Settings(date="2024-05-06T07:08:09Z"))
    seen = []
    for name in Path(path).glob("*.gz"):
        data = gzip.decompress(name.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            seen.append((fields["WARC-Type"], fields["X-Page-ID"], fields["WARC-Date"], fields.get("WARC-Profile"), rest[:size].partition(b"\r\n\r\n")[2]))
            data = rest[size + 4:]
    date = "2024-05-06T07:08:09Z"
    assert sorted(seen, key=lambda x: x[1]) == [
        ("response", "1", date, None, LONG.encode()), ("revisit", "2", date, warc.PROFILE, b""), ("response", "3", date, None, b"")]


def test_cut_archive(spark, tmp_path):
    path, _ = round_trip(spark, tmp_path, [(1, LONG)])
    name = next(Path(path).glob("*.gz"))
    name.write_bytes(gzip.compress(gzip.decompress(name.read_bytes())[:-60]))
    for crc in Path(path).glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, path).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("\r\na:"), max_size=30), max_size=6))
def test_reader_finds_records_by_length(bodies):
    stream = b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b.encode()), b.encode()) for b in bodies)
    reader, got = warc.Reader(), []
    for piece in stream.split(b"\r\n\r\n")[:-1]:
        got += [body.decode() for _, body in reader.feed(piece + b"\r\n\r\n")]
    reader.close()
    assert got == bodies
