"""What the plans must look like at scale, and the parser's batching."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteindex.functions.text import strip
from siteindex.operators import extract as X
from siteindex.operators.views import CLEANED, CLEANERS, Texts, text_of, with_view
from siteindex.plans.catalog import page_facts
from siteindex.plans.discover import candidates
from siteindex.plans.pages import crawl_records, markdown_pages, parsed, processed, site_links
from siteindex.session import ARROW_ROWS, configure, keep, shared_dir
from siteindex.sources import nodes as N
from workloads.inputs import pages as given_pages

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "pages")
    spark.read.parquet(f"{SF}/pages.parquet").withColumn("unused", F.lit(1)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "build",
    [
        processed,
        page_facts,
        site_links,
        markdown_pages,
        lambda p: crawl_records(p, "map"),
        lambda p: processed(p, CLEANERS[:2]),
        lambda p: processed(p).where("title <> 'x'").select("url", F.explode("headings")),
        lambda p: site_links(p).select("url", F.posexplode("links")),
    ],
)
def test_pages_are_scanned_narrow_parsed_once_and_not_shuffled(stored, build):
    plan = plan_of(build(stored))
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<url:string,html:string>" in plan


def test_unused_fields_cost_nothing(stored):
    plan = plan_of(processed(stored).select("url", "main_content"))
    assert "map_from_entries" not in plan and "application/ld+json" not in plan


def test_discovery_joins_on_keys_only(spark, stored):
    sites = spark.createDataFrame(
        [("s", ["https://e.com/"], None, None, 5)],
        "site_id string, urls array<string>, include_patterns array<string>, exclude_patterns array<string>, max_pages int",
    )
    plan = plan_of(candidates(sites, keep(site_links(stored))))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SortAggregate" not in plan


def test_chunks_do_not_change_the_nodes(monkeypatch):
    html = [f"<p>{i} &amp; <b>x</b></p>" for i in range(50)] + [None, "", "<![nope[x]]>", "<a href=/x>y</a>"]
    batches = [pa.array(html[:20]), pa.array(html[20:]), pa.array([], pa.string())]
    whole = [row for part in N._read_batches(iter(batches), 0) for row in part.to_pylist()]
    monkeypatch.setattr(N, "_CHUNK", 10)
    parts = list(N._read_batches(iter(batches), 0))
    assert len(parts) > 20 and [row for part in parts for row in part.to_pylist()] == whole
    assert len(whole) == len(html) and whole[50] is None and whole[51] == [] and whole[52] is None


def test_deep_and_large_pages(spark):
    n = 20_000
    cases = {
        "d": "<div>" * n + "x" + "<p>y" * n,
        "w": "<nav>n</nav><p>t <b>b</b></p>" * n,
        "b": "<p>&nbsp;" * n,
        "h": "<h1>z" * n,
    }
    rows = [(i, f"https://e.com/{name}", html) for i, (name, html) in enumerate(cases.items())]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.url[-1]: r for r in processed(df).select("url", "title", "description", "main_content").collect()}
    sizes = {name: len(row.main_content) for name, row in got.items()}
    assert sizes == {"d": 1 + n, "w": n * len("t**b**"), "b": 0, "h": n}
    # the paragraph that starts 299 characters before the end is the first short enough
    assert got["d"].description == "y" * 299 and got["b"].description == ""
    assert got["h"].title == "z" * n


def test_nested_paragraphs_are_measured_exactly(spark):
    """Around the block size and the bounds, against measuring every paragraph."""
    rows = []
    for n in (150, 400, 700, 900):
        for piece in ("<p>y", "<p><i>yy</i> ", "<p> <pre>  </pre>y", "<p><b>y</b>"):
            rows.append((len(rows), f"https://e.com/{n}", piece * n))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    read = with_view(parsed(df), CLEANED)
    texts = F.transform(
        F.filter("elements", lambda e: e["tag"] == "p"), lambda e: strip(text_of(F.col("tokens"), e))
    )
    both = read.select(X.description(F.col("elements"), Texts(F.col("texts"))).alias("got"), texts.alias("texts"))
    for row in both.collect():
        assert row.got == next((t for t in row.texts if 50 < len(t) < 300), "")


def test_nodes_describe_nesting():
    out = N._Columns()
    N._Reader(N._Marks()).read("<ul><li>a<li><a href=x>b</a></ul></i>c&nosuch;&#x41;&#150;<br>d", out)
    rows = out.to_arrow().to_pylist()[0]
    assert [r["id"] for r in rows] == list(range(len(rows)))
    texts = [r["text"] for r in rows if r["kind"] == "text"]
    assert texts == ["a", "b", "c&nosuchA–", "d"]
    first, second = [r for r in rows if r["kind"] == "el" and r["tag"] == "li"]
    assert first["last"] == second["last"] + 1  # li is not closed by the next li
    link = next(r for r in rows if r["tag"] == "a")
    assert dict(link["attrs"]) == {"href": "x"} and link["own"] & N.bit("a:top") and link["above"] & N.bit("ul li")


def test_session_settings(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    configure(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    configure(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "16"
    configure(spark)
    kept = keep(spark.range(3), "probe")
    assert kept.count() == 3 and f"{shared_dir(spark)}/probe-" in kept.inputFiles()[0]


def test_pages_transform_a_stream(spark, stored, tmp_path):
    source = str(tmp_path / "in")
    stored.select("page_id", "url", "html").write.parquet(source)
    stream = spark.readStream.schema("page_id bigint, url string, html string").parquet(source)
    query = (
        processed(stream).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == stored.count()
    assert done.select("url", "title").exceptAll(processed(stored).select("url", "title")).isEmpty()


def test_given_pages_are_spread(spark):
    plan = plan_of(given_pages(spark, SF))
    assert "hashpartitioning(page_id" in plan and f", {spark.sparkContext.defaultParallelism})" in plan
