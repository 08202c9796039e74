"""WARC packages: round trips, ZIP64 and odd ZIP files, ranges, damaged packages, edge rows."""

import io
import json
import random
import zipfile

import brute
import pytest
from pyspark.sql import functions as F

from curata.llm import warc

SCHEMA = "page_id long, url string, html string"


def _source(data):
    return warc.Source(io.BytesIO(data), len(data))


def _pages():
    r = random.Random(4)
    long = "".join(chr(r.randint(97, 122)) for _ in range(300_000))
    same = "<p>equal</p>" * 20
    rows = [(1, "http://a/é b?q=%20", long), (2, None, None), (3, "", ""), (4, "http://b/\r\nX: y", "short"), (5, "http://b/", "short"), (6, "u", "x" * 100), (7, "u", "x" * 100),
            (8, "v", "y" * 99), (9, "v", "y" * 99), (None, "n", same), (30, "n", same), (12, "n", same), (12, "n", same), (12, "m", same), (None, "k", "only null " * 20), (None, "k", "only null " * 20),
            (15, "h", "WARC/1.1\r\n\r\nPK\x05\x06\x00"), (-3, "neg", same)]
    return rows + [(100 + k, f"http://hot/{k}", "<html>hot</html>" * 30) for k in range(200)]


def _write(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "digest": F.lit("x"), "payload": F.lit(2), "package": F.lit(3)})
    return warc.write(df.repartition(4), f"{tmp_path}/warc", **more)


def test_edge_rows_match_brute_force(spark, tmp_path):
    rows = _pages()
    spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op12_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.op12(rows), key=repr)


def test_records_round_trip_in_small_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 300)  # the driver's value goes with the places; tasks keep theirs
    rows = _pages()
    packages = _write(spark, tmp_path, rows, most=4096)
    assert packages.count() > 4 and packages.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(packages).collect()
    assert all(r.error is None for r in got) and len(got) == len(rows)
    assert sorted((r.url or "", r.bytes) for r in got) == sorted((u or "", len((h or "").encode())) for _, u, h in rows)
    assert {None if r.url is None else r.url for r in got} == {u for _, u, _ in rows}
    bodies = {bytes(r.payload).decode() for r in got if r.payload is not None}
    assert bodies == {h or "" for _, _, h in rows}


def test_index_lines_by_ranges():
    lines = [b"%d %s" % (k, b"x" * (k % 7)) for k in range(50)]
    data = b"\n".join(lines) + b"\n"
    for step in (1, 2, 5, 13, 1000):
        for tail in (data, data[:-1]):
            got = [x for low in range(0, len(tail), step) for x in warc._lines(_source(b"??" + tail), 2, len(tail), low, low + step)]
            assert got == lines


def test_directories_zip64_prefix_and_comment(monkeypatch):
    def built(limit=None, count=None, prefix=b"", comment=b"", n=5):
        with monkeypatch.context() as m:
            if limit:
                m.setattr(zipfile, "ZIP64_LIMIT", limit)
            if count:
                m.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", count)
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for k in range(n):
                    z.writestr(f"archive/é{k}", bytes([k]) * (50 * k))
                z.comment = comment
        return prefix + out.getvalue()

    for kind in ({}, {"limit": 40}, {"count": 2}, {"limit": 40, "prefix": b"#!stub" * 9}, {"prefix": b"#!stub"}, {"comment": b"about PK\x05\x06 itself"}, {"limit": 10, "comment": b"c" * 300}):
        data = built(**kind)
        found = list(warc.members(_source(data)))
        assert [m.name for m in found] == [f"archive/é{k}" for k in range(5)], kind
        assert all(data[m.start:m.start + m.size] == bytes([k]) * (50 * k) for k, m in enumerate(found)), kind
    monkeypatch.setattr(warc, "RANGE", 64)  # entries over the border of two ranges
    assert len(list(warc.members(_source(built(n=40))))) == 40
    assert list(warc.members(_source(built(n=0)))) == []
    for broken in (b"", b"nothing", built()[:-30], built()[30:] + b"\0"):
        with pytest.raises(ValueError):
            list(warc.members(_source(broken)))


def test_no_index_damaged_and_compressed_packages(spark, tmp_path):
    records = [warc.record("response", f"urn:page:{k}:{k}", f"http://p/{k}", "d", 3, b"abc", None) for k in range(20)]

    def save(name, parts, how=zipfile.ZIP_STORED):
        with zipfile.ZipFile(f"{tmp_path}/{name}", "w", how) as z:
            for n, d in parts:
                z.writestr(n, d)
        return f"{tmp_path}/{name}"

    line = json.dumps({"filename": "gone.warc.gz", "offset": 0, "length": 5})
    names = [save("plain.zip", [(warc.ARCHIVE, b"".join(records))]), save("packed.zip", [(warc.ARCHIVE, b"".join(records))], zipfile.ZIP_DEFLATED),
             save("cut.zip", [(warc.ARCHIVE, b"".join(records)[:-7])]), save("lost.zip", [(warc.INDEX, f"k 1 {line}\nnot json\n")]), save("none.zip", []), f"{tmp_path}/absent.zip"]
    open(f"{tmp_path}/bad.zip", "wb").write(b"PK no zip")
    table = spark.createDataFrame([(n,) for n in [*names, f"{tmp_path}/bad.zip"]], "package string")
    got = warc.read(table).collect()
    good = [r for r in got if r.error is None]
    assert sum(r.package.endswith("plain.zip") for r in good) == 20 and all(bytes(r.payload) == b"abc" for r in good)
    assert {r.package.rpartition("/")[2] for r in got if r.error} == {"packed.zip", "cut.zip", "lost.zip", "absent.zip", "bad.zip"}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op12_warc(spark, str(tmp_path)).collect() == []
