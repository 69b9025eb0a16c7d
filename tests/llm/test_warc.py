import gzip
import hashlib

import pyarrow.parquet as pq
import pytest

from freshet.llm import warc

BIG = "<p>café</p>" * 40


def pages(spark):
    rows = [
        (5, "http://a", BIG),
        (3, "http://b", BIG),
        (9, None, BIG),
        (9, None, BIG),
        (None, "http://n", BIG),
        (1, "http://c\r\nWARC-Type: x", "short"),
        (2, "http://d", "short"),
        (4, "http://e", None),
        (6, "http://f", ""),
        (7, "http://g", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 30),
        (8, "http://h", "x\r\n\r\n" * 500_000),
        (11, "http://i", "é" * 49 + "x"),
        (12, "http://j", "é" * 49 + "x"),
        (13, "http://k", "é" * 50),
        (14, "http://l", "é" * 50),
    ]
    return rows, spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_round_trip(spark):
    rows, df = pages(spark)
    index = warc.archive_pages(df)
    got = warc.read_archive(index).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != i
        want.append((f"<urn:page:{'null' if i is None else i}>", "revisit" if again else "response",
                     len(data), hashlib.sha256(data).hexdigest(),
                     f"<urn:page:{first[html]}>" if again else None, None if again else data))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_each_record_is_a_member(spark):
    _, df = pages(spark)
    for row in warc.archive_pages(df).select("file").distinct().collect():
        path = row["file"].removeprefix("file:").replace("///", "/")
        data = open(path, "rb").read()
        side = pq.read_table(path.replace(".warc.gz", ".index.parquet")).to_pylist()
        assert sum(r["length"] for r in side) == len(data)
        for r in side:
            record = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert len(list(warc.read_records([gzip.decompress(data)]))) == len(side)


def test_monolithic_files_are_one_stream(spark, tmp_path):
    import zlib

    _, df = pages(spark)
    warc.write_monolithic(warc.page_records(df), str(tmp_path / "w"))
    for path in (tmp_path / "w").glob("part-*.gz"):
        engine = zlib.decompressobj(31)
        engine.decompress(path.read_bytes())
        assert engine.eof and not engine.unused_data


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 16])
def test_records_across_chunks(size):
    data = b"".join(
        b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"\r\n\r\n", b"abc" * 50)
    )
    got = [b for _, b in warc.read_records(data[k : k + size] for k in range(0, len(data), size))]
    assert got == [b"", b"\r\n\r\n", b"abc" * 50]


def test_damaged_streams_are_errors():
    good = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for bad in (good[:-7], good + b"junk and more", b"WARC/1.1\r\nX: 1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records([bad]))


def test_empty_table(spark):
    _, df = pages(spark)
    assert warc.read_archive(warc.archive_pages(df.limit(0))).count() == 0


def test_records_are_dated_and_odd_ids_are_null(spark):
    df = spark.createDataFrame([("7", "http://a", "x"), ("seven", "http://b", "y")], "page_id string, url string, html string")
    records = sorted(r["record"] for r in warc.page_records(df, date="2024-01-02T03:04:05Z").collect())
    assert all("\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n" in r for r in records)
    assert ["<urn:page:7>" in r or "<urn:page:null>" in r for r in records] == [True, True]
    assert "\r\nWARC-Date: 20" in warc.page_records(df).first()["record"]


def test_rows_of_a_hot_payload_can_be_split(spark):
    """The first copies are a stored table: nothing below their join holds state of its key."""
    plan = warc.page_records(pages(spark)[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Aggregate" not in plan
