import hashlib

import pytest

from coursemill.llm import warc


@pytest.fixture
def pages(spark):
    long = "é" * 600  # 1200 bytes
    rows = [
        (1, "http://a/1", long, "x"), (5, "http://a/5", long, "x"), (3, None, long, "x"), (2, "http://b/2", "short", None), (4, "http://b/4", "short", None),
        (6, "http://b/6\r\nX-Page-ID: 99", None, ""), (7, "", "", ""), (None, "http://c", long, ""), (8, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 3000, ""),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip_with_revisits(spark, pages, tmp_path):
    rows, df = pages
    path = f"file://{tmp_path}/w"
    warc.write_archive(df, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, url, html, _ in rows:
        payload = (html or "").encode()
        r = got[page_id]
        copy = len(payload) >= 1000 and html == rows[0][2] and page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if copy else ("response", None))
        assert r.payload == (None if copy else payload) and r.full_length == len(payload)
        assert r.digest == hashlib.sha1(payload).hexdigest()
        assert r.url == (url if url is None else " ".join(url.split()))


def test_header_filters_skip_payloads(spark, pages, tmp_path, monkeypatch):
    path = f"{tmp_path}/w"
    warc.write_archive(pages[1], path, file_bytes=1)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = warc.WarcReader({"path": path})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (1, 8)), IsNotNull(("url",)), GreaterThan(("page_id",), 0), EqualTo(("full_length",), 3)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan", "EqualTo"]
    parts = reader.partitions()
    assert len(parts) >= 2  # a file per record here
    seen = [r["page_id"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert seen == [1]
    read = warc.read_archive(spark, path)
    assert read.where("record_type = 'revisit'").count() == 3
    assert {r.page_id for r in read.where("record_type = 'response' AND page_id IN (1, 2, 8)").collect()} == {2, 8}


def test_archives_without_sidecars_and_without_compression(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.write_archive(pages[1].coalesce(1), str(path))
    gz = next(path.glob("*.warc.gz"))
    foreign, plain = tmp_path / "foreign", tmp_path / "plain"
    foreign.mkdir(), plain.mkdir()
    (foreign / "x.warc.gz").write_bytes(gz.read_bytes())
    import gzip

    (plain / "x.warc").write_bytes(gzip.decompress(gz.read_bytes()))
    expected = sorted(map(str, warc.read_archive(spark, str(path)).collect()))
    for folder in (foreign, plain):
        assert sorted(map(str, warc.read_archive(spark, str(folder)).collect())) == expected
    assert warc.read_archive(spark, str(foreign)).where("record_type = 'revisit'").count() == 3


def test_ranges_of_one_file_read_each_record_once(pages, tmp_path):
    warc.write_archive(pages[1].coalesce(1), str(tmp_path / "w"))
    reader = warc.WarcReader({"path": str(tmp_path / "w"), "range_bytes": "200"})
    parts = reader.partitions()
    assert len(parts) > 3
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 9


def test_empty_archive(spark, pages, tmp_path):
    warc.write_archive(pages[1].limit(0), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0
