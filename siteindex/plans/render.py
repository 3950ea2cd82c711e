"""Index documents as tables of lines, and the files and records made of them.

``lines`` holds one row per output line, so a document is never one string unless
asked for. Artifacts are ``index`` (links), ``full`` (links and text), ``context``
(text, without the Other section) and ``context_full``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteindex.constants import EMPTY_URL_ERROR, OTHER_CATEGORY, OTHER_LABEL
from siteindex.functions.urls import blank
from siteindex.operators.ranking import numbered
from siteindex.plans.catalog import RECORD
from siteindex.plans.parts import byte_parts, whole_texts, write_folders
from siteindex.session import keep, mounted

ARTIFACTS = ("index", "full", "context", "context_full")
RECORDS = "records"
RUN_ARTIFACTS = ("index", "full", RECORDS)
"""What one run makes; the context documents are made on request."""

# lines a section opens and closes with, lines per page
_SHAPE = {"index": (2, 1, 1), "full": (2, 0, 6), "context": (1, 1, 3), "context_full": (1, 1, 3)}


def page_order(catalog: DataFrame) -> DataFrame:
    """Place of each page in its site's documents.

    Sections ascend by category, pages by title, then discovery order. Keys alone are
    range-partitioned in that order; a site may lie over many partitions, whose counts
    give the places. Sections follow from counts by category.
    """
    order = ["category", "title", "rank"]
    keys = catalog.select("site_id", *order).repartitionByRange("site_id", *order)
    ranged = keep(keys.withColumn("block", F.spark_partition_id()), "order")
    placed = numbered(ranged, ["site_id"], "block", order, "entry")
    site = Window.partitionBy("site_id").orderBy("category")
    before = site.rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("category") == OTHER_CATEGORY, F.col("n")).otherwise(0)
    sections = ranged.groupBy("site_id", "category").agg(F.count(F.lit(1)).alias("n"))
    sections = sections.select(
        "site_id", "category", "n",
        (F.row_number().over(site) - 1).alias("section"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum(other).over(before), F.lit(0)).alias("others"),
    )
    return placed.join(sections, ["site_id", "category"]).select(
        "site_id", "rank", "section", "entry",
        (F.col("entry") == F.col("first")).alias("opens"),
        (F.col("entry") == F.col("first") + F.col("n") - 1).alias("closes"),
        "others",
    )


def link_line() -> Column:
    """Link to a page, with its description if it has one."""
    return F.concat(
        F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"),
        F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""),
    )


def _heading(artifact: str) -> Column:
    label = F.when(F.col("category") == OTHER_CATEGORY, OTHER_LABEL).otherwise(F.col("category"))
    if artifact in ("index", "full"):
        return F.array(F.concat(F.lit("## "), label), F.lit(""))
    return F.array(F.concat(F.lit('<section name="'), "category", F.lit('">')))


def _entry(artifact: str) -> Column:
    if artifact == "index":
        return F.array(link_line())
    if artifact == "full":
        return F.array(
            link_line(), F.lit(""), F.col("content"), F.lit(""), F.lit("---"), F.lit("")
        )
    return F.array(
        F.concat(F.lit('<page title="'), "title", F.lit('" url="'), "url", F.lit('">')),
        F.concat(F.lit("<content>"), "content", F.lit("</content>")),
        F.lit("</page>"),
    )


def _ending(artifact: str) -> Column:
    ending = {"index": [""], "full": []}.get(artifact, ["</section>"])
    return F.array(*map(F.lit, ending)).cast("array<string>")


def _has_info() -> Column:
    return F.coalesce(F.col("additional_info") != "", F.lit(False))


def _head_size(artifact: str) -> Column:
    return F.when(_has_info(), 6).otherwise(4) if artifact in ("index", "full") else F.lit(1)


def _page_lines(artifact: str) -> Column:
    """Array of numbered lines that one page adds to a document."""
    opening, closing, size = _SHAPE[artifact]
    section, entry = F.col("section"), F.col("entry")
    if artifact == "context":
        section = section - F.when(F.col("others") > 0, 1).otherwise(0)
        entry = entry - F.col("others")
    first = (
        _head_size(artifact)
        + section * (opening + closing)
        + entry * size
        + F.when(F.col("opens"), 0).otherwise(opening)
    )
    empty = F.array().cast("array<string>")
    texts = F.concat(
        F.when(F.col("opens"), _heading(artifact)).otherwise(empty),
        _entry(artifact),
        F.when(F.col("closes"), _ending(artifact)).otherwise(empty),
    )
    lines = _as_lines(artifact, texts, first)
    if artifact == "context":
        hidden = F.array().cast("array<struct<artifact:string,line_no:bigint,line:string>>")
        return F.when(F.col("category") == OTHER_CATEGORY, hidden).otherwise(lines)
    return lines


def _as_lines(artifact: str, texts: Column, first: Column) -> Column:
    return F.transform(
        texts,
        lambda text, i: F.struct(
            F.lit(artifact).alias("artifact"),
            (first + i).cast("bigint").alias("line_no"),
            text.alias("line"),
        ),
    )


def _site_lines(artifact: str) -> Column:
    """Lines before the first and after the last section."""
    if artifact in ("index", "full"):
        head = F.array(
            F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("> "), "description"), F.lit("")
        )
        info = F.when(_has_info(), F.array(F.col("additional_info"), F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return _as_lines(artifact, F.concat(head, info), F.lit(0))
    opening, closing, size = _SHAPE[artifact]
    head = F.concat(
        F.lit('<project title="'), "name", F.lit('" summary="'), "description", F.lit('">')
    )
    sections, entries = F.col("sections"), F.col("entries")
    if artifact == "context":
        sections = sections - F.when(F.col("others") > 0, 1).otherwise(0)
        entries = entries - F.col("others")
    last = 1 + sections * (opening + closing) + entries * size
    return F.concat(
        _as_lines(artifact, F.array(head), F.lit(0)),
        _as_lines(artifact, F.array(F.lit("</project>")), last),
    )


def lines(
    sites: DataFrame, catalog: DataFrame, artifacts: Sequence[str] = ARTIFACTS
) -> DataFrame:
    """``(site_id, artifact, line_no, line)`` of the documents of every site.

    A site without pages has documents without sections. Read ``catalog`` from a
    written table: keys and text are taken from it separately.
    """
    heads = sites.select("site_id", "name", "description", "additional_info")
    order = page_order(catalog).join(
        heads.select("site_id", "additional_info"), "site_id", "left"
    )
    placed = catalog.join(order, ["site_id", "rank"])
    page_rows = placed.select(
        "site_id", F.explode(F.concat(*map(_page_lines, artifacts))).alias("l")
    )
    # category counts first, then one row per site: both combine before the shuffle
    counts = (
        catalog.groupBy("site_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("site_id")
        .agg(
            F.count(F.lit(1)).alias("sections"),
            F.sum("n").alias("entries"),
            F.sum(F.when(F.col("category") == OTHER_CATEGORY, F.col("n")).otherwise(0)).alias(
                "others"
            ),
        )
    )
    site_rows = (
        heads.join(counts, "site_id", "left")
        .na.fill(0, ["sections", "entries", "others"])
        .select("site_id", F.explode(F.concat(*map(_site_lines, artifacts))).alias("l"))
    )
    return site_rows.unionByName(page_rows).select("site_id", "l.artifact", "l.line_no", "l.line")


def documents(lines: DataFrame) -> DataFrame:
    """``(site_id, artifact, text)``: whole documents, for sites of ordinary size.

    The context documents end without a line break. ``lines`` is read twice: pass a written
    table.
    """
    return whole_texts(byte_parts(lines))


def records(catalog: DataFrame) -> DataFrame:
    """``(site_id, rank, record)``: one JSON object per page, fields in fixed order."""
    return catalog.select("site_id", "rank", F.to_json(F.struct(*RECORD)).alias("record"))


PART_LINES, PART_RECORDS = 50_000, 10_000


def write_documents(lines: DataFrame, path: str, part_lines: int = PART_LINES) -> None:
    """Text files under ``artifact=…/site_id=…/part=…``, usually one part per document.

    A long document has several parts, written by different tasks; the parts in the
    order of their numbers make up the document.
    """
    keys = ["artifact", "site_id", "part"]
    parts = lines.withColumn("part", F.floor(F.col("line_no") / part_lines))
    if folder := mounted(lines.sparkSession, path):
        return write_folders(parts, keys, "line_no", folder, "txt")
    (
        parts.repartition(*keys)
        .sortWithinPartitions(*keys, "line_no")
        .select(*keys, "line")
        .write.partitionBy(*keys)
        .text(path)
    )


def write_records(catalog: DataFrame, path: str, part_records: int = PART_RECORDS) -> None:
    """JSON lines under ``site_id=…/part=…`` in discovery order."""
    keys = ["site_id", "part"]
    part = F.floor(F.col("rank") / part_records)
    if folder := mounted(catalog.sparkSession, path):
        lines = records(catalog).withColumnRenamed("record", "line").withColumn("part", part)
        return write_folders(lines, keys, "rank", folder, "json")
    (
        catalog.withColumn("part", part)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "rank")
        .select(*keys, *RECORD)
        .write.partitionBy(*keys)
        .json(path)
    )


def category_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("site_id", "category").agg(F.count(F.lit(1)).alias("pages"))


def run_summary(
    requests: DataFrame,
    catalog: DataFrame,
    output_directory: str,
    artifacts: Sequence[str] = RUN_ARTIFACTS,
) -> DataFrame:
    """Outcome of each request ``(site_id, url)``; a blank address is a failure.

    ``artifacts`` are the files that were written.
    """
    counts = catalog.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages_processed"))
    failed = blank(F.col("url"))
    return requests.join(counts, "site_id", "left").select(
        "site_id",
        (~failed).alias("success"),
        F.when(failed, EMPTY_URL_ERROR).alias("error"),
        F.when(failed, 0).otherwise(F.coalesce("pages_processed", F.lit(0))).alias(
            "pages_processed"
        ),
        F.when(failed, F.array().cast("array<string>"))
        .otherwise(F.array(*map(F.lit, artifacts)))
        .alias("files_generated"),
        F.when(failed, "").otherwise(F.lit(output_directory)).alias("output_directory"),
    )


def with_contents(summary: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``files_content``, the documents of each site by artifact; empty if none."""
    contents = documents.groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct("artifact", "text"))).alias("files_content")
    )
    none = F.create_map().cast("map<string,string>")
    return summary.join(contents, "site_id", "left").withColumn(
        "files_content", F.coalesce("files_content", none)
    )
