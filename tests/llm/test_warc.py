import gzip
import hashlib
import io
import zipfile

import pytest

from graphloom.llm import warc

KIND = "page_id long, url string, html string, payload_digest string"


def fetcher(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_range_reads_of_classic_and_zip64_packages(zip64):
    records = [warc.record("response", i, f"http://x/{i}", hashlib.sha256(p).hexdigest(), len(p), None, p) for i, p in enumerate([b"", b"abc\r\n\r\nWARC/1.1", b"x" * 70000])]
    made = warc.package(records, zip64)
    assert list(warc.read_package(fetcher(made), len(made))) == records
    if not zip64:
        assert zipfile.ZipFile(io.BytesIO(made)).testzip() is None


def test_only_ranges_are_fetched():
    made = warc.package([warc.record("response", i, None, "d", 50_000, None, b"y" * 50_000) for i in range(20)])
    asked = []
    members = warc.directory(lambda at, n: asked.append(n) or made[at : at + n], len(made))
    assert sum(asked) < len(made) / 2 and set(members) == {warc.DATA, warc.INDEX}


def test_compressed_members_and_damage_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"a" * 1000)
        z.writestr(warc.INDEX, b'- 0 {"offset": 0, "length": 1000}\\n')
    with pytest.raises(ValueError, match="compressed"):
        list(warc.read_package(fetcher(out.getvalue()), len(out.getvalue())))
    with pytest.raises(ValueError, match="no end"):
        warc.directory(fetcher(b"nothing"), 7)


def test_revisits_nulls_ties_and_repeats(spark):
    long = "é" * 60
    data = [(5, "u\r\n1", long, "clash"), (2, None, long, None), (9, "u", long, None), (1, "u", "short", None), (3, "u", "short", None), (4, "u", None, None), (2, None, long, None), (None, "u", long, None)]
    got = warc.read_packages(warc.write_packages(warc.with_revisits(spark.createDataFrame(data, KIND)), target_bytes=500)).collect()
    by = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert len(got) == len(data)
    assert by == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (1, "response", None), (3, "response", None), (4, "response", None), (None, "revisit", 2)}
    assert all(r.payload_bytes == 120 and r.payload_digest == hashlib.sha256(long.encode()).hexdigest() for r in got if r.page_id in (2, 5, 9))
    assert [(r.payload_bytes, bytes(r.payload)) for r in got if r.page_id == 4] == [(0, b"")]


def test_empty_table(spark):
    assert warc.read_packages(warc.write_packages(warc.with_revisits(spark.createDataFrame([], KIND)))).count() == 0


def test_packages_of_other_writers():
    """Several archives, an index that names one of them, a compressed one, and one without an index."""
    one, two, three = (warc.record("response", i, f"http://x/{i}", "d", 2, None, b"ab") for i in range(3))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/", b"")
        z.writestr("archive/a.warc", one + two)
        z.writestr("archive/b.warc.gz", gzip.compress(three))
        z.writestr("archive/c.warc", three + one)
        z.writestr("indexes/x.cdxj", "!meta 0\n" + f'x 1 {{"offset": "{len(one)}", "length": "{len(two)}", "filename": "a.warc"}}\n')
        z.writestr("indexes/y.cdxj", f'x 2 {{"offset": 0, "length": {len(gzip.compress(three))}, "filename": "b.warc.gz"}}\n')
        z.writestr("datapackage.json", "{}")
    made = out.getvalue()
    assert list(warc.read_package(fetcher(made), len(made))) == [two, three, three, one]


def test_files_are_read_by_range(spark, tmp_path):
    """Of a package of 2 MB only the directory, the index and one record are fetched for one record."""
    long, folder = "y" * 50_000, f"file://{tmp_path}/made"
    data = [(i, f" http://x/{i}\r\n", long + str(i), None) for i in range(40)] + [(99, None, None, None), (100, "u", "z" * 3_000_000, None)]
    listed = warc.write_files(warc.with_revisits(spark.createDataFrame(data, KIND).coalesce(1)), folder, target_bytes=1_500_000)
    files = listed.collect()
    assert len(files) >= 2 and all(f.size > 0 for f in files)
    kept = spark.createDataFrame(files, "path string, size long")
    got = {r.page_id: r for r in warc.read_files(kept, stretch=100_000).collect()}
    assert len(got) == 42 and got[3].url == " http://x/3\r\n" and bytes(got[7].payload).decode() == long + "7" and got[100].payload_bytes == 3_000_000 and got[99].url is None
    raw = open(files[0].path.removeprefix("file://"), "rb").read()
    asked = []
    fetch = lambda at, n: asked.append(n) or raw[at : at + n]
    ranges = list(warc.record_ranges(fetch, len(raw)))
    fetch(*ranges[5][1:])
    assert sum(asked) < len(raw) / 4
    assert warc.read_files(spark.createDataFrame([(None, 1)], "path string, size long")).count() == 0
    assert warc.write_files(warc.with_revisits(spark.createDataFrame([], KIND)), folder).count() == 0
