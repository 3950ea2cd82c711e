"""Page snapshots: reading them, and lookups that stand in for downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex.session import keep

PAGES = "page_id bigint, url string, html string"
RESPONSES = "url string, status int, content_type string, body string"


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Snapshot table ``pages(page_id, url, html)``; one row per URL.

    Parsing is bound by CPU. For a table of few files, ``partitions`` spreads the pages by
    id; without it they are parsed where they are read.
    """
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages.repartition(partitions, "page_id") if partitions else pages


def first_copies(pages: DataFrame) -> DataFrame:
    """One page per URL, one of those with the lowest id, for snapshots that hold copies.

    Counts per URL read no HTML and combine before the shuffle, so a URL with very many
    copies is no burden. Only URLs that do have copies join the pages, and only of these
    are rows equal in URL and id put together.
    """
    counted = pages.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")
    )
    copies = keep(counted.where(F.col("n") > 1).select("url", "first"), "copies")
    single = pages.join(copies, "url", "left_anti")
    several = pages.join(copies, "url").where(F.col("page_id").eqNullSafe(F.col("first")))
    columns = ["page_id", "url", "html"]
    return single.select(*columns).unionByName(
        several.select(*columns).dropDuplicates(["page_id", "url"])
    )


#: Names under which pages declare the encodings that can be decoded, in lower case.
ENCODINGS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "ISO-8859-1", "ascii": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1",
    "windows-1252": "windows-1252", "cp1252": "windows-1252",
    "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
#: What a byte order mark says, and where an encoding may be declared: bytes at the beginning.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
DECLARED_WITHIN = 2048
_DECLARED = r"""(?is)<(?:meta[^>]*?charset|\?xml[^>]*?encoding)\s*=\s*["']?\s*([-\w]+)"""
# the upper half of windows-1252 where it is not that of ISO-8859-1; five codes stand for themselves
_WINDOWS = {code: bytes((code,)).decode("windows-1252", "ignore") for code in range(0x80, 0xA0)}


def decoded(content: Column, declared: Column | None = None) -> Column:
    """Text of a page's bytes.

    A byte order mark decides, else the ``declared`` encoding (of a response's header, say),
    else the one the page itself declares, else UTF-8 where the bytes are valid UTF-8, else
    windows-1252. A declared UTF-8 that is not valid, or a declared UTF-16 of a page that could
    be read to find this, is not believed. Bytes that mean nothing become U+FFFD.
    """
    start = F.hex(F.substring(content, 1, 3))
    mark = F.lit(None).cast("string")
    size = F.lit(0)
    for bytes_, name in reversed(MARKS):
        has_mark = F.startswith(start, F.lit(bytes_))
        mark = F.when(has_mark, name).otherwise(mark)
        size = F.when(has_mark, len(bytes_) // 2).otherwise(size)
    known = F.create_map(*(F.lit(x) for pair in ENCODINGS.items() for x in pair))
    head = F.decode(F.substring(content, 1, DECLARED_WITHIN), "ISO-8859-1")
    in_page = F.try_element_at(known, F.lower(F.regexp_extract(head, _DECLARED, 1)))
    in_page = F.when(~F.startswith(in_page, F.lit("UTF-16")), in_page)
    named = in_page if declared is None else F.coalesce(
        F.try_element_at(known, F.lower(F.trim(declared))), in_page
    )
    is_utf8 = F.is_valid_utf8(content.cast("string"))
    believed = F.when(named.isNull() | ((named == "UTF-8") & ~is_utf8), None).otherwise(named)
    guessed = F.when(is_utf8, "UTF-8").otherwise("windows-1252")
    encoding = F.coalesce(mark, believed, guessed)
    rest = F.substring(content, size + 1, F.octet_length(content))
    one_byte = F.decode(rest, "ISO-8859-1")
    far = "".join(map(chr, (c for c, text in _WINDOWS.items() if text)))
    near = "".join(text for text in _WINDOWS.values() if text)
    return (
        F.when(encoding == "UTF-8", F.make_valid_utf8(rest.cast("string")))
        .when(encoding == "ISO-8859-1", one_byte)
        .when(encoding == "windows-1252", F.translate(one_byte, far, near))
        .when(encoding == "UTF-16LE", _utf16(rest, "UTF-16LE"))
        .otherwise(_utf16(rest, "UTF-16BE"))
    )


def _utf16(content: Column, encoding: str) -> Column:
    """Text of whole pairs of bytes; half a character at the end is left out."""
    even = F.floor(F.octet_length(content) / 2) * 2
    return F.decode(F.substring(content, F.lit(1), even.cast("int")), encoding)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Local or shared HTML files as pages, by their encoding; the file address is the URL."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.xxhash64("path").alias("page_id"),
        F.col("path").alias("url"),
        decoded(F.col("content")).alias("html"),
    )


def pages_of(responses: DataFrame, crawl: bool = False) -> DataFrame:
    """Pages that a download would have returned: no error status.

    A crawl only takes pages with status 200. Rows keep their ``page_id`` if they have one;
    else it is a hash of the URL, the same for all copies (see ``first_copies``).
    """
    status = F.col("status")
    known = "page_id" in responses.columns
    return responses.where(status == 200 if crawl else status < 400).select(
        F.col("page_id") if known else F.xxhash64("url").alias("page_id"),
        "url",
        F.col("body").alias("html"),
    )


def fetched(pages: DataFrame) -> DataFrame:
    """Pages with content; a missing or empty body is a failed download."""
    return pages.where(F.length("html") > 0)
