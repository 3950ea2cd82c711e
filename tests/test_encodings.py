"""Bytes of pages to text."""

import pytest
from pyspark.sql import functions as F

from siteindex.sources.snapshot import decoded, read_files

TEXT = "<p>é ü ß</p>"
CASES = {
    "plain": (b"<p>x</p>", None, "<p>x</p>"),
    "utf-8": (TEXT.encode(), None, TEXT),
    "utf-8 with mark": (b"\xef\xbb\xbf" + TEXT.encode(), "iso-8859-1", TEXT),
    "utf-16le": ("日本".encode("utf-16-le"), "utf-16le", "日本"),
    "utf-16 marked": ("\ufeff日本 \U0001f600".encode("utf-16-le"), None, "日本 \U0001f600"),
    "utf-16be marked": ("\ufeff日本".encode("utf-16-be") + b"\x00", None, "日本"),
    "by header": (TEXT.encode("latin-1"), " ISO-8859-1 ", TEXT),
    "by meta": (b'<meta charset="latin1">\x80', None, '<meta charset="latin1">\x80'),
    "by long meta": (b"<meta http-equiv=x content='text/html; charset=cp1252'>\x80\x81", None,
                     "<meta http-equiv=x content='text/html; charset=cp1252'>€\x81"),
    "by xml": (b"<?xml version='1.0' encoding='iso-8859-1'?>\xe9", None, "<?xml version='1.0' encoding='iso-8859-1'?>é"),
    "header before meta": (b"<meta charset=utf-8>\xe9", "windows-1252", "<meta charset=utf-8>é"),
    "wrongly utf-8": (b"<meta charset=utf-8>\x93q\x94", None, "<meta charset=utf-8>“q”"),
    "wrongly utf-16": (b"<meta charset=utf-16>x", None, "<meta charset=utf-16>x"),
    "unknown name": (b"<meta charset=klingon>\xe9", "martian", "<meta charset=klingon>é"),
    "neither": (b"\xe9\x99", None, "é™"),
    "empty": (b"", None, ""),
    "none": (None, None, None),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, bytearray(c) if c is not None else None, d) for name, (c, d, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, content binary, declared string")
    read = df.select("name", decoded(F.col("content"), F.col("declared")).alias("text"))
    return {r.name: r.text for r in read.collect()}


@pytest.mark.parametrize("name", CASES)
def test_decoded(results, name):
    assert results[name] == CASES[name][2]


def test_files_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(TEXT.encode("utf-16"))
    (tmp_path / "b.html").write_bytes(TEXT.encode("latin-1"))
    rows = {r.url.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path / "*.html")).collect()}
    assert {r.html for r in rows.values()} == {TEXT} and rows["a.html"].url.startswith("file:/")
