"""Parts of documents by bytes, and single files put together from them."""

import json
import os
import random
from urllib.parse import quote

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siteindex.plans import parts, render
from siteindex.plans.catalog import RECORD
from siteindex.sources.files import FileWriter, Written

ODD = ["", "plain", 'quo"te \\ back', "tab\tline\nfeed\r\x08\x0c", "\x00\x01\x1f\x7f", "é日本   / <b>"]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(7)
    rows, texts = [], {}
    for site in ("a", "b/c?d=1 é", "long"):
        for artifact in ("index", "context"):
            lines = [rng.choice(ODD[:2] + ODD[2:3] + [ODD[5] * 3]) for _ in range(900 if site == "long" else 5)]
            rows += [(site, artifact, i, line) for i, line in enumerate(lines)]
            texts[site, artifact] = "\n".join(lines) + ("\n" if artifact == "index" else "")
    rng.shuffle(rows)
    shape = "site_id string, artifact string, line_no long, line string"
    return spark.createDataFrame(rows, shape).repartition(7), texts


@pytest.mark.parametrize(("block", "size"), [(4096, 1 << 18), (16, 40), (1, 1)])
def test_parts_meet(documents, monkeypatch, block, size):
    monkeypatch.setattr(parts, "BLOCK_LINES", block)
    lines, texts = documents
    found = parts.byte_parts(lines, size).collect()
    for key, text in texts.items():
        mine = sorted((r.start, r.text) for r in found if (r.site_id, r.artifact) == key)
        assert "".join(t for _, t in mine) == text
        assert [s for s, _ in mine] == [
            sum(len(t.encode()) for _, t in mine[:i]) for i in range(len(mine))
        ]
        assert {r.total for r in found if (r.site_id, r.artifact) == key} == {len(text.encode())}
        longest = max(len(line.encode()) for line in text.split("\n"))
        assert max(len(t.encode()) for _, t in mine) <= size + longest + 1
    whole = {(r.site_id, r.artifact): r.text for r in parts.whole_texts(parts.byte_parts(lines, size)).collect()}
    assert whole == texts


@pytest.mark.parametrize(("block", "size"), [(4096, 1 << 18), (16, 40)])
def test_files_are_exact(documents, monkeypatch, tmp_path, block, size):
    monkeypatch.setattr(parts, "BLOCK_LINES", block)
    lines, texts = documents
    for _ in range(2):  # a run that is repeated replaces the files
        parts.write_files(lines, str(tmp_path / "out"), size)
    found = {
        (site, name.removesuffix(".txt")): (tmp_path / "out" / site / name).read_bytes()
        for site in os.listdir(tmp_path / "out")
        for name in os.listdir(tmp_path / "out" / site)
    }
    assert found == {(quote(s, safe="*-._"), a): t.encode() for (s, a), t in texts.items()}


def test_parts_that_do_not_meet_are_no_file(tmp_path):
    writer = FileWriter("file:" + str(tmp_path / "x"))
    rows = [("f.txt", 0, 6, "ab"), ("f.txt", 4, 6, "ef"), ("g.txt", 0, 2, "é")]
    shape = ["file", "start", "total", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], shape)
    message = writer.write(iter([batch]))
    assert [(s.start, s.size) for s in message.stretches] == [(0, 2), (4, 2)]
    with pytest.raises(ValueError, match="f.txt do not meet"):
        writer.commit([message, None])
    assert (tmp_path / "x" / "g.txt").read_text() == "é"
    middle = pa.RecordBatch.from_arrays([pa.array([v]) for v in ("f.txt", 2, 6, "cd")], shape)
    writer.commit([message, writer.write(iter([middle])), Written()])
    assert (tmp_path / "x" / "f.txt").read_text() == "abcdef"
    assert sorted(os.listdir(tmp_path / "x")) == ["f.txt", "g.txt"]
    writer.write(iter([middle]))
    writer.abort([])
    assert sorted(os.listdir(tmp_path / "x")) == ["f.txt", "g.txt"]


def test_json_list_of_records(spark):
    rows = [("s", i * 3, *(ODD[(i + k) % len(ODD)] for k in range(len(RECORD)))) for i in range(8)]
    rows.append(("one", 5, *([None] * len(RECORD))))
    catalog = spark.createDataFrame(rows, "site_id string, rank int, " + ", ".join(f"{c} string" for c in RECORD))
    sites = spark.createDataFrame([("s",), ("one",), ("none",)], "site_id string")
    lines = parts.record_lines(sites, catalog)
    got = {r.site_id: r.text for r in parts.whole_texts(parts.byte_parts(lines)).collect()}
    for site in ("s", "one", "none"):
        pages = [dict(zip(RECORD, r[2:], strict=True)) for r in rows if r[0] == site]
        assert got[site] == json.dumps(pages, indent=2, ensure_ascii=False)


def test_every_control_character(spark):
    text = "".join(map(chr, range(0x250)))
    got = spark.range(1).select(parts.json_text(F.lit(text))).first()[0]
    assert got == json.dumps(text, ensure_ascii=False)


def laid_out(folder):
    """Bytes of the files below a folder, by the folder that holds them."""
    return {
        os.path.relpath(at, folder): b"".join((at / f).read_bytes() for f in names if f[0] not in "._")
        for at, _, names in folder.walk()
        if any(f[0] not in "._" for f in names)
    }


def test_folders_are_those_of_the_writer_of_spark(spark, tmp_path, monkeypatch):
    names = ["plain", "100%_\"#'*/:=?\\{}[]^ <>|.~", "\x01\x0f\x10\x1f\x7f", "", None]
    rows = [(n, a, i, None if i == 3 else f"{n} {i} é\\n") for n in names for a in ("index", "full") for i in range(7)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "site_id string, artifact string, line_no long, line string")
    odd = [(n, i, *(None if (i + k) % 3 else ODD[k] for k in range(len(RECORD)))) for n in names[:3] for i in range(5)]
    catalog = spark.createDataFrame(odd, "site_id string, rank int, " + ", ".join(f"{c} string" for c in RECORD))
    # '' and null share a folder; with one of them the order of its lines is given
    lines = lines.where("site_id is null or site_id <> ''")

    def write(name):
        render.write_documents(lines.repartition(3), str(tmp_path / name / "documents"), 4)
        render.write_records(catalog.repartition(3), str(tmp_path / name / "records"), 2)

    write("quick")
    with monkeypatch.context() as m:
        m.setattr(render, "mounted", lambda *_: None)
        write("spark")
    got = laid_out(tmp_path / "quick")
    assert got == laid_out(tmp_path / "spark") and len(got) == 4 * 2 * 2 + 3 * 3
    found = spark.read.text(str(tmp_path / "quick" / "documents")).groupBy("site_id", "artifact").count().collect()
    assert {(r.site_id, r.artifact, r["count"]) for r in found} == {
        (n, a, 7) for n in names if n != "" for a in ("index", "full")
    }
    # no file made by the writer that starts a process for each
    assert not list((tmp_path / "quick").rglob("part-*.crc"))
    assert (tmp_path / "quick" / "documents" / "_SUCCESS").exists()
    assert sorted(os.listdir(tmp_path / "quick")) == ["documents", "records"]


def test_folders_of_sites_without_a_name_keep_all_lines(spark, tmp_path):
    lines = spark.createDataFrame(
        [(s, "index", i, f"{s}{i}") for s in ("", None) for i in range(3)],
        "site_id string, artifact string, line_no long, line string",
    )
    render.write_documents(lines, str(tmp_path / "out"))
    [text] = laid_out(tmp_path / "out").values()
    assert sorted(text.decode().split()) == sorted(f"{s}{i}" for s in ("", None) for i in range(3))


def test_folders_replace_nothing(spark, tmp_path):
    lines = spark.createDataFrame([("s", "index", 0, "x")], "site_id string, artifact string, line_no long, line string")
    render.write_documents(lines.where("false"), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["_SUCCESS"]
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        render.write_documents(lines, str(tmp_path / "out"))
    broken = lines.withColumn("line", F.raise_error(F.lit("broken line")).cast("string"))
    with pytest.raises(Exception, match="broken line"):
        render.write_documents(broken, str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["out"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"site_id=s{i}").mkdir()
        (tmp_path / f"site_id=s{i}" / "part-0.txt").write_text("x\n")
    context = spark.sparkContext
    context.setJobGroup("listing", "folders")
    try:
        files = spark.read.text(str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [s for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    tasks = [status.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 60
    assert files.count() == 60
