import random

from pyspark.sql import functions as F

from siteindex.functions import text as X


def squeezed(text):
    chunks = (part.strip() for line in text.splitlines() for part in line.strip().split("  "))
    return " ".join(chunk for chunk in chunks if chunk)


def test_squeeze_and_strip(spark):
    rng = random.Random(3)
    pieces = [" ", "  ", "\t", "\n", "\r\n", "\x0b", " ", "\xa0", "　", "\x1c", "a", "bc", "é", "\x1f"]
    texts = ["", " ", "\n\n"] + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.squeeze(F.col("t")), X.strip(F.col("t"))).collect():
        assert r[1] == squeezed(r.t), repr(r.t)
        assert r[2] == r.t.strip(), repr(r.t)


def test_squeeze_is_linear_in_long_blank_runs(spark):
    df = spark.createDataFrame([("a" + "\t" * 200_000 + "b",)], "t string")
    assert df.select(F.length(X.squeeze(F.col("t")))).first()[0] == 200_002


def test_title_case(spark):
    texts = ["en/474.html", "A/b-c", "x2y don't STOP", "éCOLE ünder", "", "中文abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.title_case(F.col("t"))).collect()] == [t.title() for t in texts]


def test_cut_at(spark):
    df = spark.createDataFrame([("A | B - C",), ("A - B | C",), ("A-B",), (" | x",)], "t string")
    got = [r[0] for r in df.select(X.cut_at(F.col("t"), (" | ", " - "))).collect()]
    assert got == ["A", "A", "A-B", ""]
