"""Archives: round trip, ranges, ZIP forms of others."""

import datetime
import gzip
import hashlib
import io
import zipfile

import pyarrow.fs as pafs
import pytest

from alamatika.llm import warc as W

BIG = "é" * 700  # 1400 bytes


def log(spark):
    when = datetime.datetime(2025, 1, 2, 3, 4, 5)
    rows = [
        (1, "jl. a\r\nb %0A", BIG, when), (2, None, BIG, None), (3, "x", "x" * 999, when), (4, "x", "x" * 999, when),
        (5, "y", None, when), (6, "", "", when), (7, "z", BIG + "2", when), (None, "n", BIG, when), (2, None, BIG, None),
        (8, "t", "\r\n\r\nWARC/1.1\r\n" * 300, when),
    ]
    return rows, spark.createDataFrame(
        [(*r, "k") for r in rows], "address_id long, raw_input string, output_json string, created_at timestamp, digest string"
    )


@pytest.mark.parametrize("archive,block", [(64 << 20, 4 << 20), (400, 500)])
def test_round_trip(spark, monkeypatch, archive, block):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(W, "RANGE_BYTES", block)
    rows, df = log(spark)
    got = W.archive_round_trip(spark, df, with_payload=True).collect()
    want = []
    for number, target, payload, _ in rows:
        data = (payload or "").encode()
        revisit = payload == BIG and number != 2
        want.append((
            "" if number is None else str(number), target, len(data), hashlib.sha1(data).hexdigest(),
            "revisit" if revisit else "response", "2" if revisit else None, None if revisit else payload or "",
        ))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert W.archive_round_trip(spark, df.limit(0)).count() == 0


def test_archives_are_zip_files_of_stored_members(spark, tmp_path):
    _, df = log(spark)
    manifest = W.write_archives(df, str(tmp_path)).collect()
    assert sum(r["n_records"] for r in manifest) == 10
    for r in manifest:
        with zipfile.ZipFile(r["path"]) as z:
            assert z.namelist() == [W.DATA, W.INDEX] and z.testzip() is None
            assert all(i.compress_type == 0 for i in z.infolist())
            assert gzip.decompress(z.read(W.DATA)).count(b"WARC-Record-ID") == r["n_records"]


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment"])
def test_directory_of_plain_and_zip64_files(tmp_path, comment):
    path = tmp_path / "other.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = comment
        z.writestr("packed", "x" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"wide data")
        z.writestr("plain", "plain data")
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        members = {m.name: m for m in W.central_directory(f)}
        assert set(members) == {"wide", "plain"}
        for name, m in members.items():
            assert f.read_at(m.size, W.data_start(f, m)).decode() == f"{name} data"


def test_broken_files_are_refused(tmp_path):
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "no.zip")) as f, pytest.raises(ValueError):
        W.central_directory(f)
    out = io.BytesIO()
    z = W.ZipWriter(out)
    z.begin("m")
    z.add(b"abc")
    z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as f:
        assert f.read("m") == b"abc"
