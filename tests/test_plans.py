"""Plans over many sites on a small web, against literal rows."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siteindex import config
from siteindex.operators.patterns import first_categories, pattern_count
from siteindex.operators.ranking import numbered
from siteindex.plans import catalog as catalog_module
from siteindex.plans import render
from siteindex.plans.catalog import catalog, categorised, category, only, page_facts
from siteindex.plans import crawl as crawl_module
from siteindex.plans.crawl import crawl
from siteindex.plans.discover import discover
from siteindex.plans.pages import processed, site_links
from siteindex.plans.run import run
from siteindex.session import keep
from siteindex.sources.snapshot import first_copies, pages_of

H0, H1 = "https://h0.org", "https://h1.org"
RULES = [("API", ["/api/"], ["api"]), ("Guide", None, ["guide", "Never"]), ("Zed", ["/z"], None)]

#: Title and links of each page: repeats, a fragment, a file, another host, missing pages.
WEB = {
    f"{H0}/docs/0": ("Plain zero", ["/docs/1", "2", "/docs/1#x", "/docs/3.pdf", f"{H1}/docs/0", "/api/5", "/docs/9", "/docs/1"]),
    f"{H0}/docs/1": ("Guide one", ["/docs/0", "/docs/4"]),
    f"{H0}/docs/2": ("Plain two", ["/docs/4", "/docs/5", "/docs/6"]),
    f"{H0}/docs/4": ("API four", []),
    f"{H0}/docs/5": ("Plain five", ["/docs/2"]),
    f"{H0}/docs/6": ("Guide six", ["/docs/7"]),
    f"{H0}/docs/7": ("Plain seven", []),
    f"{H0}/api/5": ("Anything", ["/docs/0"]),
    f"{H1}/docs/0": ("Plain many", [f"/docs/{i}" for i in range(1, 16)]),
} | {f"{H1}/docs/{i}": (f"Plain leaf {i}", []) for i in range(1, 16)}
LEAD = "This paragraph is long enough to serve as the description of its page."


def page_rows():
    rows = []
    for i, (url, (title, refs)) in enumerate(WEB.items()):
        anchors = "".join(f'<a href="{ref}">l</a>' for ref in refs)
        lead = f"<p>{LEAD}</p>" if title == "Guide one" else ""
        rows.append((i, url, f"<article><h1>{title}</h1>{lead}<p>text {i}</p>{anchors}</article>"))
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")


SITES = [
    ("s0", [f"{H0}/docs/0", f"{H0}/docs/1", f"{H0}/docs/0"], [], [], 100),
    ("s1", [f"{H0}/docs/2", f"{H0}/docs/999"], ["/docs/"], ["/docs/5"], 3),
    ("s2", ["https://nowhere.org/"], [], [], None),
    ("s3", [], [], [], 10),
    ("s4", [f"{H0}/docs/2"], [], [], 0),
    ("s5", [f"{H1}/docs/0", f"{H1}/docs/3"], None, None, 5),
]
DISCOVERED = {
    "s0": [f"{H0}/docs/0", f"{H0}/docs/1", f"{H0}/docs/2", f"{H0}/api/5", f"{H0}/docs/9", f"{H0}/docs/4"],
    "s1": [f"{H0}/docs/2", f"{H0}/docs/4", f"{H0}/docs/6"],
    "s2": ["https://nowhere.org/"],
    "s5": [f"{H1}/docs/{i}" for i in range(5)],
}
CATALOGUE = [
    ("s0", 0, f"{H0}/docs/0", "Plain zero", "Other"),
    ("s0", 1, f"{H0}/docs/1", "Guide one", "Guide"),
    ("s0", 2, f"{H0}/docs/2", "Plain two", "Other"),
    ("s0", 3, f"{H0}/api/5", "Anything", "API"),
    ("s0", 5, f"{H0}/docs/4", "API four", "API"),
    ("s1", 0, f"{H0}/docs/2", "Plain two", "Other"),
    ("s1", 1, f"{H0}/docs/4", "API four", "API"),
    ("s1", 2, f"{H0}/docs/6", "Guide six", "Guide"),
    *(("s5", i, f"{H1}/docs/{i}", f"Plain leaf {i}" if i else "Plain many", "Other") for i in range(5)),
]


@pytest.fixture(scope="module")
def sites(spark):
    rows = [
        (s, f"Name {s}", f"About {s}", "More" if s == "s0" else None, urls, inc, exc, RULES, cap, 3, "docs")
        for s, urls, inc, exc, cap in SITES
    ]
    return spark.createDataFrame(rows, config.SITES)


def test_discover(spark, sites, pages):
    rows = discover(sites, site_links(pages)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.site_id, []).append(r.url)
    assert got == DISCOVERED
    assert all(got[r.site_id][r.rank] == r.url for r in rows)


@pytest.fixture(scope="module")
def built(spark, sites, pages):
    return keep(catalog(sites, pages), "catalog")


def test_catalog(built):
    got = sorted((r.site_id, r.rank, r.url, r.title, r.category) for r in built.collect())
    assert got == sorted(CATALOGUE)
    assert built.select("source").distinct().collect()[0][0] == "link_discovery"


def test_only_listed_pages_are_parsed(spark, pages):
    listed = keep(spark.createDataFrame([(f"{H0}/docs/4",), ("x",)], "url string"), "listed")
    df = page_facts(only(pages, listed))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")
    assert [r.title for r in df.collect()] == ["API four"]


def s0_documents(content):
    """The documents of the first site; ``content`` is the text of each page."""
    zero, one, two, four, five = (f"{H0}/docs/0", f"{H0}/docs/1", f"{H0}/docs/2", f"{H0}/docs/4", f"{H0}/api/5")
    links = {
        four: f"- [API four]({four})", five: f"- [Anything]({five})", one: f"- [Guide one]({one}): {LEAD}",
        two: f"- [Plain two]({two})", zero: f"- [Plain zero]({zero})",
    }
    head = "# Name s0\n\n> About s0\n\nMore\n\n"
    index = (
        head + f"## API\n\n{links[four]}\n{links[five]}\n\n## Guide\n\n{links[one]}\n\n"
        f"## Optional\n\n{links[two]}\n{links[zero]}\n\n"
    )
    whole = {url: f"{link}\n\n{content[url]}\n\n---\n\n" for url, link in links.items()}
    full = (
        head + "## API\n\n" + whole[four] + whole[five] + "## Guide\n\n" + whole[one]
        + "## Optional\n\n" + whole[two] + whole[zero]
    )
    page = lambda url, title: f'<page title="{title}" url="{url}">\n<content>{content[url]}</content>\n</page>\n'
    start = '<project title="Name s0" summary="About s0">\n'
    known = (
        '<section name="API">\n' + page(four, "API four") + page(five, "Anything") + "</section>\n"
        '<section name="Guide">\n' + page(one, "Guide one") + "</section>\n"
    )
    other = '<section name="Other">\n' + page(two, "Plain two") + page(zero, "Plain zero") + "</section>\n"
    return {
        "index": index, "full": full, "context": start + known + "</project>",
        "context_full": start + known + other + "</project>",
    }


def test_documents(sites, built):
    table = keep(render.lines(sites, built), "lines")
    texts = {(r.site_id, r.artifact): r.text for r in render.documents(table).collect()}
    content = {r.url: r.content for r in built.collect()}
    for artifact, text in s0_documents(content).items():
        assert texts["s0", artifact] == text
    assert texts["s2", "index"] == "# Name s2\n\n> About s2\n\n"
    assert texts["s5", "context"] == '<project title="Name s5" summary="About s5">\n</project>'
    assert len(texts) == len(SITES) * len(render.ARTIFACTS)
    numbers = table.groupBy("site_id", "artifact").agg(F.count("*").alias("n"), F.max("line_no").alias("m"), F.countDistinct("line_no").alias("d"))
    assert all(r.n == r.m + 1 == r.d for r in numbers.collect())


def test_a_hot_site_is_ordered_by_several_tasks(spark):
    rows = [("hot", i, f"C{i % 3}", f"t{(i * 7919) % 1000:03d}") for i in range(2000)] + [("cold", 0, "Other", "x")]
    df = spark.createDataFrame(rows, "site_id string, rank int, category string, title string")
    order = keep(render.page_order(df), "places")
    got = {(r.site_id, r["rank"]): r for r in order.collect()}
    expected = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[3], r[1]))
    assert [got["hot", r[1]].entry for r in expected] == list(range(2000))
    assert sum(r.opens for r in got.values()) == sum(r.closes for r in got.values()) == 4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # for so few rows
    blocks = df.repartitionByRange("site_id", "category", "title", "rank").where("site_id = 'hot'")
    tasks = blocks.select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def joined_parts(folder):
    files = sorted(folder.glob("part=*/part-*"), key=lambda p: int(p.parent.name[5:]))
    return "".join(p.read_text(encoding="utf-8") for p in files), len(files)


def test_run_writes_documents_and_records(spark, sites, pages, built, tmp_path):
    summary = {r.site_id: r for r in run(sites, pages, str(tmp_path), part_lines=20, part_records=3).collect()}
    content = {r.url: r.content for r in built.collect()}
    for artifact in ("index", "full"):
        text, n = joined_parts(tmp_path / "documents" / f"artifact={artifact}" / "site_id=s0")
        assert text == s0_documents(content)[artifact] and n == -(-text.count("\n") // 20)
    text, n = joined_parts(tmp_path / "records" / "site_id=s0")
    records = [json.loads(line) for line in text.splitlines()]
    assert [r["url"] for r in records] == [row[2] for row in CATALOGUE if row[0] == "s0"] and n == 2
    assert all(list(r) == ["url", "title", "description", "content", "category", "source"] for r in records)
    assert {s: r.pages_processed for s, r in summary.items()} == {"s0": 5, "s1": 3, "s2": 0, "s3": 0, "s4": 0, "s5": 5}
    assert summary["s0"].files_generated == ["index", "full", "records"]
    assert not (tmp_path / "documents" / "artifact=context").exists()


def test_run_names_the_files_it_wrote(sites, pages, tmp_path):
    row = run(sites.where("site_id = 's0'"), pages, str(tmp_path), context=True, contents=True).first()
    assert row.files_generated == ["index", "full", "context", "context_full", "records"]
    assert {p.name[9:] for p in (tmp_path / "documents").glob("artifact=*")} == set(row.files_content)


def test_run_summary(spark, built):
    requests = spark.createDataFrame([("s0", "e.com"), ("s4", "x"), ("blank", " \t"), ("none", None)], "site_id string, url string")
    rows = {r.site_id: r for r in render.run_summary(requests, built, "/out").collect()}
    assert (rows["s0"].success, rows["s0"].pages_processed, rows["s0"].output_directory) == (True, 5, "/out")
    assert rows["s0"].files_generated == ["index", "full", "records"] and rows["s0"].error is None
    assert (rows["s4"].success, rows["s4"].pages_processed) == (True, 0)
    for site in ("blank", "none"):
        assert (rows[site].success, rows[site].pages_processed, rows[site].files_generated) == (False, 0, [])
        assert rows[site].error == "URL is required and cannot be empty"


def test_contents_join_the_summary(spark, sites, built):
    requests = spark.createDataFrame([("s0", "e.com"), ("blank", "")], "site_id string, url string")
    texts = render.documents(render.lines(sites, built, ("index", "full")))
    rows = {r.site_id: r for r in render.with_contents(render.run_summary(requests, built, "/o"), texts).collect()}
    assert set(rows["s0"].files_content) == {"index", "full"} and rows["blank"].files_content == {}
    assert rows["s0"].files_content["index"].startswith("# Name s0\n\n> About s0\n\nMore\n\n## ")


#: Address and depth in visiting order from the first page; of 15 links of a page 10 count.
VISITED = [
    (f"{H0}/docs/0", 0),
    (f"{H0}/docs/1", 1), (f"{H0}/docs/2", 1), (f"{H1}/docs/0", 1), (f"{H0}/api/5", 1),
    (f"{H0}/docs/4", 2), (f"{H0}/docs/5", 2), (f"{H0}/docs/6", 2),
    *((f"{H1}/docs/{i}", 2) for i in range(1, 11)),
    (f"{H0}/docs/7", 3),
]


@pytest.mark.parametrize("mode,max_pages,max_depth,expected", [
    ("docs", 30, 3, VISITED), ("docs", 7, 5, VISITED[:7]), ("docs", 100, 1, VISITED[:5]),
    ("docs", 5, 0, VISITED[:1]), ("other", 30, 2, VISITED[:18]),
])
def test_crawl(spark, pages, mode, max_pages, max_depth, expected):
    starts = {"a": f"{H0}/docs/0", "b": f"{H1}/docs/7", "c": "https://nowhere.org/"}
    df = crawl(spark.createDataFrame(list(starts.items()), "site_id string, url string"), pages, mode, max_pages, max_depth)
    rows = df.orderBy("site_id", "rank").collect()
    assert [(r.url, r.depth) for r in rows if r.site_id == "a"] == expected
    assert [r.rank for r in rows if r.site_id == "a"] == list(range(len(expected)))
    assert [(r.site_id, r.url, r.rank) for r in rows if r.site_id != "a"] == [("b", f"{H1}/docs/7", 0)]
    assert {r.traversal_mode for r in rows} == {"documentation"}


def test_crawl_with_settings_of_each_site(spark, pages):
    rows = [("a", f"{H0}/docs/0", "docs", 3, 5), ("b", f"{H0}/docs/0", "map", 9, 9),
            ("c", f"{H0}/docs/0", None, None, 1), ("d", f"{H0}/docs/0", "docs", 9, -1)]
    starts = spark.createDataFrame(rows, "site_id string, url string, traversal_mode string, max_pages int, max_depth int")
    got = crawl(starts, pages).orderBy("site_id", "rank").collect()
    reached = {site: [(r.url, r.depth) for r in got if r.site_id == site] for site in "abcd"}
    assert reached == {"a": VISITED[:3], "b": VISITED[:1], "c": VISITED[:5], "d": []}
    assert {(r.site_id, r.traversal_mode, r.structure_info is None) for r in got} == {
        ("a", "documentation", True), ("b", "structure", False), ("c", "documentation", True)}


def test_crawl_map_has_structure_and_html(spark, pages):
    starts = spark.createDataFrame([("a", f"{H0}/docs/0")], "site_id string, url string")
    row = crawl(starts, pages, "map", keep_html=True).first()
    assert row.traversal_mode == "structure" and row.structure_info.heading_count == 1 and row.html.startswith("<article>")


def test_crawl_parses_visited_pages_only(spark, monkeypatch):
    at = "https://x.org/docs/{}".format
    refs = "".join(f'<a href="{at(name)}">l</a>' for name in ["empty", "bad", "gone", 1, 2, 3, 4])
    bodies = {"home": refs, "empty": "", "bad": '<a href="http://[x/">t</a>', **{str(i): f"<p>{i}</p>" + refs for i in range(40)}}
    rows = [(i, at(name), f"<article>{body}</article>" if body else "") for i, (name, body) in enumerate(bodies.items())]
    snapshot = keep(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    read = []
    records = crawl_module.crawl_records_of
    monkeypatch.setattr(crawl_module, "crawl_records_of", lambda p, modes: read.append(p) or records(p, modes))
    starts = spark.createDataFrame([("a", at("home")), ("b", at("home"))], "site_id string, url string")
    got = crawl(starts, snapshot, "docs", 4, 3).orderBy("site_id", "rank").collect()
    assert [(r.site_id, r.url, r.rank, r.depth) for r in got] == [
        (site, at(name), rank, min(rank, 1)) for site in "ab" for rank, name in enumerate(["home", 1, 2, 3])]
    parsed = [r.url for p in read for r in p.collect()]
    # two pages fail and give their room to the next; the other pages are never read
    assert sorted(parsed) == sorted(map(at, ["home", "empty", "bad", 1, 2, 3]))


def test_first_copies(spark, pages):
    assert sorted(first_copies(pages).collect()) == sorted(pages.collect())
    hot = f"{H0}/docs/0"
    copies = spark.range(500).select((F.col("id") + 10_000).alias("page_id"), F.lit(hot).alias("url"), F.lit("<p>old</p>").alias("html"))
    kept = first_copies(pages.unionByName(copies))
    assert kept.count() == pages.count()
    assert kept.where(F.col("url") == hot).first().page_id == 0


def test_first_copies_of_responses(spark):
    rows = [("u", 200, "t", "a"), ("u", 200, "t", "a"), ("u", 200, "t", "b"), ("v", 200, "t", "c")]
    responses = spark.createDataFrame(rows, "url string, status int, content_type string, body string")
    assert sorted(r.url for r in first_copies(pages_of(responses)).collect()) == ["u", "v"]
    numbered_rows = responses.withColumn("page_id", F.when(F.col("body") == "b", 1).otherwise(2).cast("bigint"))
    kept = {r.url: r.html for r in first_copies(pages_of(numbered_rows)).collect()}
    assert kept == {"u": "b", "v": "c"}


@pytest.mark.parametrize("tag", ['a href="/x"', "h2", "code"])
def test_elements_that_are_never_closed(spark, tag):
    html = "<article>" + f"<{tag}>some text " * 8000 + "</article>"
    df = spark.createDataFrame([(1, "https://e.com/", html)], "page_id bigint, url string, html string")
    began = time.monotonic()
    assert page_facts(df).first().content.count("some text") == 8000
    assert time.monotonic() - began < 60


def test_links_without_text_do_not_fail_a_page(spark):
    rows = [(1, "https://e.com/1", '<article><a href="http://[x/"> <i2>\n</i2></a>words</article>'),
            (2, "https://e.com/2", '<article><a href="http://[x/"> <i2>x</i2></a>words</article>')]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    titles = {r.page_id: r.title for r in df.join(processed(df).select("url", "title"), "url").collect()}
    assert titles[1] != "Error Processing Content" and titles[2] == "Error Processing Content"


def test_numbered_spreads_a_hot_group(spark):
    rows = [("hot", i // 10, i % 10) for i in range(1000)] + [("cold", 5, 1), ("cold", 2, 9)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, b int, o int")
    got = numbered(df, ["g"], "b", ["o"], "n").collect()
    assert all(r.n == r.b * 10 + r.o for r in got if r.g == "hot")
    assert sorted((r.b, r.n) for r in got if r.g == "cold") == [(2, 0), (5, 1)]


def test_config(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "name": "N", "description": "D", "urls": ["https://e.com"],
        "category_rules": {"Z": {"url_patterns": ["/z"]}, "A": {"title_patterns": ["a"]}},
    }))
    (tmp_path / "b.json").write_text(json.dumps({"name": "only"}))
    sites = config.read_sites(spark, str(tmp_path / "*.json"), {"max_pages": 7, "name": "", "urls": None})
    rows = {r.name: r for r in sites.collect()}
    assert [c.category for c in rows["N"].category_rules] == ["Z", "A"]
    assert rows["N"].max_pages == 7 and rows["N"].max_depth is None
    errors = {r.site_id.rsplit("/", 1)[1]: r.error for r in config.violations(sites).collect()}
    assert errors == {"b.json": "Missing required configuration key: description"}
    empty = sites.withColumn("urls", F.array().cast("array<string>"))
    assert {r.error for r in config.violations(empty.where("description is not null")).collect()} == {"urls must be a non-empty list"}
    with pytest.raises(Exception, match="Missing required configuration key: description"):
        config.validated(sites).collect()
    assert config.validated(sites.where("name = 'N'")).count() == 1
    default = config.with_defaults(spark.createDataFrame([("x",) + (None,) * 10], config.SITES)).first()
    assert (default.max_pages, default.max_depth, default.traversal_mode, default.urls) == (100, 3, "docs", ["https://example.com"])


def test_requested_sites(spark):
    df = spark.createDataFrame([("a", "@e.com/x"), ("b", "  ")], "site_id string, url string")
    rows = config.requested_sites(df).collect()
    assert [(r.site_id, r.urls, r.description) for r in rows] == [("a", ["https://e.com/x"], "Documentation generated from https://e.com/x")]


def test_failed_page_keeps_its_links(spark):
    html = '<nav><a href="/a">a</a></nav><article><a href="http://[x/">t</a></article>'
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id bigint, url string, html string")
    assert page_facts(pages).first().title == "Error Processing Content"
    assert site_links(pages).first().links == ["https://e.com/a"]


MANY_RULES = [
    ([f"/p{i}/"] if i % 3 else None, [f"t{i}x", None] if i % 2 else []) for i in range(5000)
] + [(["/docs"], None), ([None], ["late"]), (None, None)]


@pytest.fixture(scope="module")
def ruled(spark):
    rules = [(f"c{i}" if i != 7 else None, u, t) for i, (u, t) in enumerate(MANY_RULES)] + [None]
    everything = [("first", ["/never"], []), ("all titles", [], [""]), ("all", [""], [])]
    rows = [("hot", rules), ("empty", everything), ("none", []), ("null", None)]
    return spark.createDataFrame(rows, f"site_id string, category_rules {config.RULES}")


def test_many_rules_are_those_of_single_tests(spark, ruled):
    urls = [f"https://h.org/p{i}/p{i * 7 % 5000}/{'docs' if i % 5 else ''}" for i in range(0, 6000, 3)]
    rows = [("hot", i, u, f"T{i * 11 % 6000}x LATE" if i % 4 else None) for i, u in enumerate(urls)]
    for site in ("empty", "none", "null", "unknown"):
        rows += [(site, 0, "https://h.org/docs", "Late"), (site, 1, "https://h.org/x", None), (site, 5000, None, None)]
    titled = keep(spark.createDataFrame(rows, "site_id string, rank int, url string, title string"), "titled")
    got = categorised(titled, ruled).collect()
    expected = titled.join(ruled, "site_id", "left").select(
        "site_id", "rank", "url", "title",
        category(F.col("url"), F.col("title"), F.col("category_rules")).alias("category"),
    )
    assert sorted(map(repr, got)) == sorted(map(repr, expected.collect()))
    assert len({r.category for r in got}) > 1000


def test_rules_do_not_travel_with_the_texts(spark, ruled):
    rows = [("hot", i, f"/p{i}/", "x") for i in range(9000)]
    titled = keep(spark.createDataFrame(rows, "site_id string, rank int, url string, title string"), "titled")
    blocks = first_categories(titled, ruled, F.expr("rank div 4096"))
    assert blocks.count() == 9000
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "MapInArrow" in plan


def test_catalogue_by_many_rules(spark, sites, pages, built, monkeypatch):
    monkeypatch.setattr(catalog_module, "FEW_PATTERNS", 0)
    order = ["site_id", "rank", "url"]
    assert catalog(sites, pages).orderBy(order).collect() == built.orderBy(order).collect()


def test_patterns_are_counted(spark, ruled):
    counted = {r.site_id: r.n for r in ruled.select("site_id", pattern_count().alias("n")).collect()}
    assert counted["none"] == counted["null"] == 0 and counted["empty"] == 3
    assert counted["hot"] == sum(len(u or ()) + len(t or ()) for u, t in MANY_RULES)
