"""One run: from sites and a page snapshot to the files of every site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.plans.catalog import catalog
from siteindex.plans.parts import record_lines, write_files
from siteindex.plans.render import (
    ARTIFACTS,
    PART_LINES,
    PART_RECORDS,
    RECORDS,
    RUN_ARTIFACTS,
    documents,
    lines,
    run_summary,
    with_contents,
    write_documents,
    write_records,
)
from siteindex.session import keep


def run(
    sites: DataFrame,
    pages: DataFrame,
    output: str,
    context: bool = False,
    contents: bool = False,
    part_lines: int = PART_LINES,
    part_records: int = PART_RECORDS,
    single_files: bool = False,
) -> DataFrame:
    """Write index, full index and records below ``output``; return the summary per site.

    ``context`` adds the two context documents. ``contents`` adds the documents themselves
    to the summary, for sites of ordinary size. A longer document has parts of ``part_lines``
    lines, records come in parts of ``part_records`` rows. With ``single_files`` there is one
    file for each document instead, ``files/site/artifact.txt``, and one JSON list of records.
    """
    sites = keep(sites, "sites")
    built = keep(catalog(sites, pages), "catalog")
    artifacts = ARTIFACTS if context else [name for name in RUN_ARTIFACTS if name in ARTIFACTS]
    table = keep(lines(sites, built, artifacts), "lines")
    if single_files:
        every = table.unionByName(record_lines(sites, built))
        write_files(keep(every, "file-lines"), f"{output}/files")
    else:
        write_documents(table, f"{output}/documents", part_lines)
        write_records(built, f"{output}/records", part_records)
    requests = sites.select("site_id", F.get("urls", F.lit(0)).alias("url"))
    summary = run_summary(requests, built, output, [*artifacts, RECORDS])
    return with_contents(summary, documents(table)) if contents else summary
