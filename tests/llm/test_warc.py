import gzip
import hashlib

import pytest

from corpusmill.llm import warc


def brute(rows):
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(first.get(data, key), key)
    return first


LONG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 8
ROWS = [(5, "http://a/1", LONG), (2, "http://a/2 x\r\nEvil: 1", LONG), (9, None, LONG), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "http://é/", "x" * 99), (1, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "z" * 300_000)]


def test_round_trip_equals_brute_force(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages, f"file://{tmp_path}/w").collect()}
    first = brute(ROWS)
    assert len(got) == len(ROWS)
    for key, _, html in ROWS:
        data, r = (html or "").encode(), got[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        other = first.get(data, key)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if other == key else ("revisit", other))
    # the archive is in WARC format, with the payloads of responses alone
    blocks = {}
    for f in sorted((tmp_path / "w/unique").glob("part-*")):
        for head, block in warc.parse([gzip.decompress(f.read_bytes())]):
            blocks[int(head["X-Page-Id"])] = head, block
    assert blocks[2][1] == LONG.encode() and blocks[5][1] == b"" and blocks[5][0]["WARC-Refers-To"] == blocks[2][0]["WARC-Record-ID"]
    assert "Evil" not in blocks[2][0] and blocks[5][0]["WARC-Profile"] == warc.PROFILE
    assert spark.sparkContext is not None


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (None, "u", "q" * 200)]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)


def test_payloads_around_the_separator(spark):
    """Payloads that begin, end and consist of parts of the separator, and a large one."""
    ends = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\n\r\n\r", "WARC/1.1\r\n\r\n"]
    rows = [(i, "u", a + body + b) for i, (a, body, b) in enumerate((a, body, b) for a in ends for body in ("", "x" * 120) for b in ends)]
    rows.append((len(rows), "u", ("line\r\n\r\n" * 4_000_000)))
    pages = spark.createDataFrame(rows[:-1], "page_id long, url string, html string").union(spark.range(len(rows) - 1, len(rows)).selectExpr("id", "'u'", "repeat('line\\r\\n\\r\\n', 4000000)"))
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages).collect()}
    first = {}
    for key, _, html in rows:
        r, other = got[key], first.setdefault(html, key) if len(html) >= 100 else key
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert r["refers_to"] == (None if other == key else other)


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_cut_records_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"]))
