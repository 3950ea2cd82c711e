"""Documents as parts by bytes, and their single files.

A document is never one string on the way: running sums over blocks of lines give the byte at
which each line begins, lines are joined to parts of bounded size within their block, and the
parts are written by many tasks.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence

from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteindex.plans.catalog import RECORD
from siteindex.sources.files import OrderedFiles

#: Artifacts whose last line has no line break.
UNENDED = ("context", "context_full", "records")
RECORD_FILE = "records"
#: Lines that are summed together, and bytes after which a part ends with its line.
BLOCK_LINES, PART_BYTES = 4096, 1 << 18
_DOCUMENT = ["site_id", "artifact"]


def byte_parts(lines: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(site_id, artifact, start, total, text)``: parts of the documents, by first byte.

    Put together in order of ``start`` they are the documents of ``total`` bytes each. ``lines``
    is read twice: pass a written table. The lines of a block move once; a part is longer than
    ``part_bytes`` only by its last line.
    """
    block = F.floor(F.col("line_no") / BLOCK_LINES)
    sized = lines.withColumn("block", block).withColumn(
        "bytes", F.octet_length("line").cast("bigint") + 1
    )
    document = Window.partitionBy(*_DOCUMENT)
    earlier = document.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy(*_DOCUMENT, "block").agg(
        F.sum("bytes").alias("n"), F.max("line_no").alias("last")
    )
    unended = F.col("artifact").isin(*UNENDED)
    blocks = sums.select(
        *_DOCUMENT, "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.sum("n").over(document) - F.when(unended, 1).otherwise(0)).alias("total"),
        F.max("last").over(document).alias("last"),
    )
    inner = Window.partitionBy(*_DOCUMENT, "block").orderBy("line_no")
    within = F.sum("bytes").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.join(blocks, [*_DOCUMENT, "block"]).withColumn(
        "start", F.col("before") + F.coalesce(within, F.lit(0))
    )
    ending = F.when(unended & (F.col("line_no") == F.col("last")), "").otherwise("\n")
    pieces = placed.withColumn("piece", F.concat("line", ending)).withColumn(
        "part", F.floor(F.col("start") / part_bytes)
    )
    joined = F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY line_no)")
    return (
        pieces.groupBy(*_DOCUMENT, "block", "part", "total")
        .agg(F.min("start").alias("start"), joined.alias("text"))
        .select(*_DOCUMENT, "start", "total", "text")
    )


def whole_texts(parts: DataFrame) -> DataFrame:
    """``(site_id, artifact, text)`` put together from parts."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "text")))
    text = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    return parts.groupBy(*_DOCUMENT).agg(text.alias("text"))


def json_text(text: Column) -> Column:
    """A JSON string that only escapes what has to be, control characters with small letters."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    some = F.when(text.rlike("[\\x00-\\x1f]"), escaped).otherwise(plain)
    return F.coalesce(F.concat(F.lit('"'), some, F.lit('"')), F.lit("null"))


def record_lines(sites: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines of one JSON list for each site: its pages in order, indented by two."""
    last = catalog.groupBy("site_id").agg(F.max("rank").cast("bigint").alias("last"))
    lasts = sites.select("site_id").join(last, "site_id", "left")
    line = F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("[]").alias("line"))
    opened = F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("[").alias("line"))
    closed = F.struct((F.col("last") + 2).alias("line_no"), F.lit("]").alias("line"))
    around = lasts.select(
        "site_id",
        F.explode(
            F.when(F.col("last").isNull(), F.array(line)).otherwise(F.array(opened, closed))
        ).alias("l"),
    ).select("site_id", "l.line_no", "l.line")
    fields = [
        F.concat(F.lit(f'    "{name}": '), json_text(F.col(name))) for name in RECORD
    ]
    body = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))
    comma = F.when(F.col("rank") < F.col("last"), ",").otherwise("")
    pages = catalog.join(last, "site_id").select(
        "site_id", (F.col("rank").cast("bigint") + 1).alias("line_no"),
        F.concat(body, comma).alias("line"),
    )
    return around.unionByName(pages).select(
        "site_id", F.lit(RECORD_FILE).alias("artifact"), "line_no", "line"
    )


def write_files(lines: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """One file for each document: ``site/artifact.txt``, and ``site/records.json``.

    Sites are percent-encoded in the paths. ``lines`` is read twice: pass a written table.
    """
    ending = F.when(F.col("artifact") == RECORD_FILE, ".json").otherwise(".txt")
    site = F.replace(F.url_encode("site_id"), F.lit("+"), F.lit("%20"))
    parts = byte_parts(lines, part_bytes).select(
        F.concat(site, F.lit("/"), "artifact", ending).alias("file"), "start", "total", "text"
    )
    lines.sparkSession.dataSource.register(OrderedFiles)
    (
        parts.sortWithinPartitions("file", "start")
        .write.format(OrderedFiles.name())
        .mode("append")
        .save(path)
    )


#: Characters that folders named after values do not show as they are, the sign of escapes first.
_ESCAPED = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(key: str) -> Column:
    """``key=value`` as ``partitionBy`` names folders."""
    plain = F.col(key).cast("string")
    escaped = plain
    for c in _ESCAPED:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    odd = plain.rlike(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
    value = F.when(odd, escaped).when(plain != "", plain).otherwise(NO_VALUE)
    return F.concat(F.lit(f"{key}="), value)


def write_folders(
    lines: DataFrame, keys: Sequence[str], order: str, folder: str, ending: str
) -> None:
    """The ``line`` of each group of ``keys`` in one file of a folder that is named after them.

    The layout is that of ``partitionBy``. ``folder`` is one that all machines have mounted: there
    Spark's writer starts a process for the permissions of every file it makes, which takes
    longer than the writing of a small one. All files appear together at the end.
    """
    system = pafs.LocalFileSystem()
    if system.get_file_info(folder).type != pafs.FileType.NotFound:
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {folder} already exists.")
    parent, name = posixpath.split(folder.rstrip("/"))
    beside = posixpath.join(parent, f"_{name}-{uuid.uuid4().hex}")
    text = F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).cast("binary")
    size = F.octet_length("text").cast("bigint")
    group = Window.partitionBy("file").orderBy(order)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    file = F.concat_ws("/", *map(folder_name, keys), F.lit(f"part-00000.{ending}"))
    placed = (
        lines.select(file.alias("file"), order, text.alias("text"))
        .repartition("file")
        .select(
            "file",
            F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"),
            F.sum(size).over(every).alias("total"),
            "text",
        )
    )
    lines.sparkSession.dataSource.register(OrderedFiles)
    system.create_dir(beside, recursive=True)
    try:
        (
            placed.sortWithinPartitions("file", "start")
            .write.format(OrderedFiles.name())
            .mode("append")
            .save(beside)
        )
        system.open_output_stream(posixpath.join(beside, "_SUCCESS")).close()
        system.move(beside, folder)
    except BaseException:
        system.delete_dir(beside)
        raise
